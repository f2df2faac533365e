"""Word lists, patterns, lookup tables and constants that decide results.

Everything here is data, kept in one place so that the operators stay free of literals.  Regular expressions
use only syntax that java.util.regex and RE2 read alike; word characters are spelled ``[\\p{L}\\p{N}_]`` because
plain ``\\w`` is ASCII in both engines while the semantics wanted are Unicode.
"""

from __future__ import annotations

# --- fixed values: whitespace stripped by a Unicode-aware strip ------------------------------------------------
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the same set without the line feed, as the body of a character class
LINE_SPACE = r" \t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WORDS = r"[\p{L}\p{N}_]+"
WORD_START = rf"(?:^|{NOT_WORD})"
WORD_END = rf"(?:$|{NOT_WORD})"

# --- fixed values: section types (priority, window size, overlap, display name) --------------------------------
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 250
SECTION_MIN_CHARS = 50
SECTION_CONFIG = [
    ("abstract", 1, 800, 200, "摘要/Abstract"),
    ("introduction", 2, 1000, 250, "引言/Introduction"),
    ("methodology", 3, 1000, 250, "方法/Methodology"),
    ("experimental", 4, 1200, 300, "实验/Experimental"),
    ("fabrication", 5, 1000, 250, "制备/Fabrication"),
    ("characterization", 6, 900, 200, "表征/Characterization"),
    ("results", 7, 1200, 300, "结果/Results"),
    ("discussion", 8, 800, 200, "讨论/Discussion"),
    ("conclusion", 9, 600, 100, "结论/Conclusion"),
    ("performance", 6, 1200, 300, "性能数据/Performance"),
    ("references", 99, 0, 0, "参考文献/References"),
    ("default", 10, DEFAULT_CHUNK_SIZE, DEFAULT_CHUNK_OVERLAP, "其他"),
]
WHOLE_TEXT_TITLE = "文档内容"
PREAMBLE_TITLE = "文档开头"

# --- fixed values: heading families; each is (plain words, numbered words, words after #, numbered after #) -----
# "plain" words open a line, "numbered" ones follow an optional "3." style number.
SECTION_HEADINGS = {
    "abstract": (
        ["Abstract", "摘要"],
        ["Abstract", "摘要"],
        ["Abstract", "摘要"],
        ["Abstract", "摘要"],
    ),
    "introduction": (
        ["Introduction", "引言", "前言"],
        ["Introduction", "引言", "前言"],
        ["Introduction", "引言", "前言"],
        ["Introduction", "引言", "前言"],
    ),
    "methodology": (
        ["Methodology", "Method", "Methods", "方法", "实验方法", "Materials and Methods", "材料与方法",
         "Experimental Methods"],
        ["Method", "Methods", "Methodology", "方法", "实验方法"],
        ["Methodology", "Method", "Methods", "方法", "实验方法", "Materials and Methods", "材料与方法"],
        [],
    ),
    "experimental": (
        ["Experimental", "Experiment", "实验"],
        ["Experimental", "实验"],
        ["Experimental", "Experiment", "实验"],
        [],
    ),
    "fabrication": (
        ["Fabrication", "制备", "Device Fabrication", "器件制备", "Solar Cell Fabrication", "太阳能电池制备",
         "Cell Fabrication", "电池制备"],
        ["Fabrication", "制备"],
        ["Fabrication", "制备", "Device Fabrication", "器件制备", "Solar Cell Fabrication", "太阳能电池制备"],
        [],
    ),
    "characterization": (
        ["Characterization", "表征", "测试", "Measurement", "Device Characterization", "器件表征",
         "Electrical Characterization", "电学表征", "Optical Characterization", "光学表征"],
        ["Characterization", "表征"],
        ["Characterization", "表征", "测试", "Measurement", "Device Characterization", "器件表征"],
        [],
    ),
    "results": (
        ["Results", "结果", "Experimental Results", "实验结果"],
        ["Results", "结果", "实验结果"],
        ["Results", "结果", "Experimental Results", "实验结果"],
        [],
    ),
    "discussion": (
        ["Discussion", "讨论", "Analysis", "分析", "Comparison", "比较", "Optimization", "优化"],
        ["Discussion", "讨论"],
        ["Discussion", "讨论", "Analysis", "分析", "Comparison", "比较"],
        ["Discussion", "讨论"],
    ),
    "conclusion": (
        ["Conclusion", "Conclusions", "结论", "总结", "Summary", "概要", "Future Work", "未来工作", "Outlook", "展望"],
        ["Conclusion", "结论", "总结"],
        ["Conclusion", "Conclusions", "结论", "总结", "Summary", "概要"],
        ["Conclusion", "结论", "总结"],
    ),
    "performance": (
        ["Performance", "性能", "Device Performance", "器件性能", "Photovoltaic Performance", "光伏性能"],
        ["Performance", "性能"],
        ["Performance", "性能", "Efficiency", "效率", "Device Performance", "器件性能", "Photovoltaic Performance",
         "光伏性能", "Solar Cell Performance", "太阳能电池性能", "Power Conversion Efficiency", "功率转换效率", "PCE",
         "Table.*Performance", "Figure.*Performance", "Comparison.*Performance",
         "Device Characteristics", "器件特性", "Electrical Properties", "电学性质", "Optical Properties", "光学性质"],
        ["Performance", "Efficiency", "性能", "效率"],
    ),
    "references": (
        ["References", "参考文献", "Bibliography", "文献"],
        ["References", "参考文献", "Bibliography", "文献"],
        ["References", "参考文献", "Bibliography", "文献"],
        ["References", "参考文献", "Bibliography", "文献"],
    ),
}
# lines that look like an entry of a reference list also open a references section
REFERENCE_LINE_STARTS = [
    r"\[1\]",
    r"\(1\)",
    r"[0-9]+\.\s+[A-Z]",
    rf"1\.\s+{WORD}.*?[0-9]{{4}}",
    r"\[[0-9]+\].*\n\[[0-9]+\]",
    rf"{WORD}+,?\s+{WORD}.*?\([0-9]{{4}}\)",
    r"https?://doi\.org/",
    r"doi:",
]

# --- fixed values: passage tags -------------------------------------------------------------------------------
NUMBER_UNITS = [
    r"[0-9]+\.?[0-9]*\s*%",
    r"[0-9]+\.?[0-9]*\s*eV",
    r"[0-9]+\.?[0-9]*\s*°[CF]",
    r"[0-9]+\.?[0-9]*\s*nm",
    r"[0-9]+\.?[0-9]*\s*[mµ]m",
    r"[0-9]+\.?[0-9]*\s*[VM]A",
    r"[0-9]+\.?[0-9]*\s*W",
    r"[0-9]+\.?[0-9]*\s*[Ωω]",
    r"[0-9]+\.?[0-9]*\s*cm[-−]?[²2]",
]
MAX_NUMBERS = 20
METHOD_STEMS = [
    "fabricat", "prepar", "synthes", "deposit", "coat", "anneal", "spin", "evaporat", "sputter", "diffusion",
    "method", "process", "procedure", "technique", "approach", "protocol", "recipe",
]
COMPARISON_STEMS = [
    "compar", "versus", "vs", "differ", "higher", "lower", "better", "worse", "superior", "inferior", "outperform",
    "exceed", "relative to", "contrast",
]
METRIC_PATTERNS = [
    ("PCE", "PCE"),
    ("Voc", r"V[_\s]?oc"),
    ("Jsc", r"J[_\s]?sc"),
    ("FF", r"(?:FF|fill\s+factor)"),
    ("efficiency", "efficiency"),
    ("PLQY", "PLQY"),
    ("mobility", "mobility"),
    ("stability", "stability"),
    ("lifetime", "lifetime"),
    ("degradation", "degradation"),
    ("bandgap", r"(?:bandgap|band\s+gap)"),
]
# material terms; the first is the chemical-formula shape, matched without regard to case
FORMULA_SHAPE = r"[A-Z][a-z]?[A-Z][a-z]*(?:I[₃₂]|Br[₃₂]|Cl[₃₂])?"
MATERIAL_TERMS = ["perovskite", "silicon", "CIGS", "CdTe", "P3HT", "PCBM", "Spiro", "PTAA"]
MAX_TERMS = 10

# --- fixed values: bibliography-like passages ------------------------------------------------------------------
REFERENCE_MARKS = [
    r"\[[0-9]+\]",
    r"\([0-9]{4}\)",
    rf"[0-9]+\.\s+{WORD}.*?[0-9]{{4}}",
    r"doi:",
    r"DOI:",
    r"https?://doi\.org/",
    r"journal|proceedings|conference|nature|science|phys\.|chem\.|j\.",
    rf"{WORD}+,\s*{WORD}+\.\s*{WORD}*\.?",
    r"et\s+al\.",
    r"vol\.",
    r"pp\.",
    r"no\.",
    r"issue",
]
CITATION = r"\[[0-9]+\]|\([0-9]{4}\)"
REFERENCE_LINE = [r"^[0-9]+\.", r"^\[[0-9]+\]"]
REFERENCE_LINE_YEAR = r"\([0-9]{4}\)"
REFERENCE_LINE_NAME = rf"{WORD}+,\s*{WORD}+"

# --- fixed values: domain keywords for extraction hints --------------------------------------------------------
ML_KEYWORDS = [
    "random forest", "neural network", "deep learning", "gradient boosting", "support vector", "svm", "k-nearest",
    "knn", "decision tree", "regression", "classification", "cnn", "rnn", "lstm", "transformer", "gnn",
    "graph neural", "xgboost", "adaboost", "ensemble", "linear regression", "logistic regression", "pca",
    "clustering",
]
PERFORMANCE_KEYWORDS = [
    "pce", "power conversion efficiency", "voc", "open-circuit voltage", "jsc", "short-circuit current", "ff",
    "fill factor", "bandgap", "homo", "lumo", "mobility", "conductivity", "t50", "t80", "lifetime", "degradation",
    "stability",
]
HINT_MATERIALS = ["perovskite", "silicon"]
METRIC_VALUE_UNITS = ["%", "eV", "V", "mA/cm²", "cm²/Vs"]

# --- fixed values: extraction thresholds and labels -------------------------------------------------------------
MIN_EXTRACT_CHARS = 30
MIN_ENTITY_CONFIDENCE = 0.7
MIN_RELATION_CONFIDENCE = 0.65
DEFAULT_CONFIDENCE = 0.8
ENTITY_TYPE_LABELS = {
    "MATERIAL": "Material", "DEVICE": "Device", "METRIC": "Metric", "PROCESS": "Process",
    "MEASUREMENT": "Measurement", "PARAMETER": "Parameter", "CONCEPT": "Concept", "AUTHOR": "Author",
    "INSTITUTION": "Institution", "PAPER": "Paper", "FORMULA": "Formula", "FORM": "Formula",
    "EQUATION": "Formula", "EQ": "Formula",
}
RELATION_TYPES = [
    "USES", "HAS_PROPERTY", "FABRICATED_BY", "AUTHORED_BY", "AFFILIATED_WITH", "MEASURES", "IMPROVES", "CITES",
    "CONTAINS", "RELATED_TO", "INFLUENCES", "IS_A", "PREDICTS", "OPTIMIZES", "TRAINED_ON", "COMPOSES", "ENHANCES",
    "CORRELATES_WITH",
]
SHORT_TYPE_LABELS = {
    "Material": ["MATERIAL", "MAT"], "Device": ["DEVICE", "DEV"], "Metric": ["METRIC", "MET"],
    "Process": ["PROCESS", "PROC"], "Measurement": ["MEASUREMENT", "MEAS"], "Author": ["AUTHOR", "AUTH"],
    "Institution": ["INSTITUTION", "INST"], "Formula": ["FORMULA", "FORM", "EQUATION", "EQ"],
    "Parameter": ["PARAMETER", "PARAM"], "Concept": ["CONCEPT", "CONC"],
}
NAME_KEYWORDS = {
    "Material": [
        "mapbi3", "fapbi3", "cspbi3", "perovskite", "silicon", "si", "sno2", "tio2", "fto", "ito", "azo",
        "spiro-ometad", "p3ht", "pcbm", "ptb7", "pm6", "y6", "cdte", "cigs", "cigse", "gaas", "inp", "au", "ag",
        "al", "cu", "eva", "poe", "kf", "licf3so2", "oxide", "metal", "polymer", "organic", "dopant",
    ],
    "Device": [
        "solar cell", "cell", "module", "panel", "tandem", "heterojunction", "perc", "bifacial", "led", "laser",
        "photodetector", "etl", "htl", "layer", "junction", "electrode", "contact", "busbar", "ribbon",
    ],
    "Metric": [
        "pce", "efficiency", "voc", "jsc", "ff", "fill factor", "bandgap", "mobility", "conductivity", "resistance",
        "transmittance", "reflectance", "absorption", "t50", "t80", "lifetime", "degradation", "thickness",
        "temperature", "voltage", "current", "power", "energy", "lcoe", "yield", "ratio", "%", "ev", "mv", "ma",
        "cm",
    ],
    "Process": [
        "spin coating", "coating", "evaporation", "sputtering", "pecvd", "ald", "annealing", "thermal", "sintering",
        "etching", "plasma", "deposition", "fabrication", "passivation", "doping", "treatment", "cleaning",
        "texturing",
    ],
    "Measurement": [
        "xrd", "sem", "tem", "afm", "xps", "ftir", "raman", "uv-vis", "pl", "el", "j-v", "i-v", "cv", "eqe", "iqe",
        "ipce", "impedance", "spectroscopy", "microscopy", "diffraction", "analysis", "characterization", "am1.5g",
    ],
}
FORMULA_OPENERS = ["$", "\\", "="]
FORMULA_MARKS = ["=", "\\frac", "\\mathrm", "\\sum", "\\int", "\\sqrt", "^", "_", "\\times", "\\div"]
NO_ENTITY_PHRASES = [
    "no entities", "does not contain", "cannot extract", "no scientific content", "bibliographic references only",
    "consists solely of", "does not have any",
]

# --- fixed values: abbreviation dictionary (abbreviation -> full names, preferred first) -------------------------
ABBREVIATIONS = {
    "pce": ["Power Conversion Efficiency", "Photovoltaic Efficiency", "Solar Cell Efficiency",
            "Conversion Efficiency"],
    "voc": ["Open-Circuit Voltage", "Open Circuit Voltage", "V_oc"],
    "jsc": ["Short-Circuit Current Density", "Short Circuit Current", "J_sc"],
    "ff": ["Fill Factor"],
    "eqe": ["External Quantum Efficiency"],
    "iqe": ["Internal Quantum Efficiency"],
    "ipce": ["Incident Photon-to-Current Efficiency"],
    "plqy": ["Photoluminescence Quantum Yield"],
    "mapbi3": ["Methylammonium Lead Iodide", "MAPbI3", "CH3NH3PbI3"],
    "fapbi3": ["Formamidinium Lead Iodide", "FAPbI3", "HC(NH2)2PbI3"],
    "cspbi3": ["Cesium Lead Iodide", "CsPbI3"],
    "ito": ["Indium Tin Oxide", "Indium-Tin Oxide"],
    "fto": ["Fluorine-Doped Tin Oxide", "Fluorine Doped Tin Oxide"],
    "pcbm": ["Phenyl-C61-Butyric Acid Methyl Ester", "[6,6]-Phenyl C61 butyric acid methyl ester"],
    "p3ht": ["Poly(3-hexylthiophene)", "Poly(3-hexylthiophene-2,5-diyl)"],
    "ptb7": ["Poly[[4,8-bis[(2-ethylhexyl)oxy]benzo[1,2-b:4,5-b']dithiophene-2,6-diyl][3-fluoro-2-"
             "[(2-ethylhexyl)carbonyl]thieno[3,4-b]thiophenediyl]]"],
    "pm6": ["Poly[(2,6-(4,8-bis(5-(2-ethylhexyl-3-fluoro)thiophen-2-yl)-benzo[1,2-b:4,5-b']dithiophene))-alt-"
            "(5,5-(1',3'-di-2-thienyl-5',7'-bis(2-ethylhexyl)benzo[1',2'-c:4',5'-c']dithiophene-4,8-dione)]"],
    "y6": ["2,2'-((2Z,2'Z)-((12,13-bis(2-ethylhexyl)-3,9-diundecyl-12,13-dihydro-[1,2,5]thiadiazolo[3,4-e]"
           "thieno[2'',3'':4',5']thieno[2',3':4,5]pyrrolo[3,2-g]thieno[2',3':4,5]thieno[3,2-b]indole-2,10-diyl)"
           "bis(methanylylidene))bis(5,6-difluoro-3-oxo-2,3-dihydro-1H-indene-2,1-diylidene))dimalononitrile"],
    "spiro-ometad": ["2,2',7,7'-Tetrakis[N,N-di(4-methoxyphenyl)amino]-9,9'-spirobifluorene", "Spiro-MeOTAD"],
    "etl": ["Electron Transport Layer", "Electron-Transport Layer"],
    "htl": ["Hole Transport Layer", "Hole-Transport Layer"],
    "perc": ["Passivated Emitter and Rear Cell", "Passivated Emitter Rear Cell"],
    "hjt": ["Heterojunction", "Hetero-Junction"],
    "tandem": ["Tandem Solar Cell", "Multi-Junction Solar Cell"],
    "pecvd": ["Plasma-Enhanced Chemical Vapor Deposition", "Plasma Enhanced CVD"],
    "ald": ["Atomic Layer Deposition"],
    "pvd": ["Physical Vapor Deposition"],
    "cbd": ["Chemical Bath Deposition"],
    "xrd": ["X-Ray Diffraction", "X Ray Diffraction"],
    "sem": ["Scanning Electron Microscopy", "Scanning Electron Microscope"],
    "tem": ["Transmission Electron Microscopy", "Transmission Electron Microscope"],
    "afm": ["Atomic Force Microscopy", "Atomic Force Microscope"],
    "xps": ["X-Ray Photoelectron Spectroscopy"],
    "ftir": ["Fourier Transform Infrared Spectroscopy"],
    "uv-vis": ["Ultraviolet-Visible Spectroscopy", "UV-Vis Spectroscopy"],
    "pl": ["Photoluminescence"],
    "el": ["Electroluminescence"],
    "rf": ["Random Forest"],
    "svm": ["Support Vector Machine"],
    "nn": ["Neural Network"],
    "cnn": ["Convolutional Neural Network"],
    "rnn": ["Recurrent Neural Network"],
    "gnn": ["Graph Neural Network"],
    "gbdt": ["Gradient Boosting Decision Tree"],
    "xgboost": ["Extreme Gradient Boosting"],
    "dnn": ["Deep Neural Network"],
}

# --- fixed values: question understanding -----------------------------------------------------------------------
QUESTION_TYPES = [
    ("numerical", ["pce", "efficiency", "percentage", "%", "ratio", "how much", "how many", "what is the value",
                   "what number", "what were the", "achieved", "reported", "measured", "power conversion",
                   "conversion efficiency"]),
    ("comparison", ["compare", "comparison", "difference", "versus", "vs", "vs.", "better", "worse", "higher",
                    "lower", "more", "less", "how do", "how does", "differ", "contrast"]),
    ("mechanistic", ["why", "how does", "how did", "mechanism", "reason", "cause", "explain how", "what causes",
                     "how to", "process", "method"]),
    ("conceptual", ["what is", "what are", "define", "definition", "characteristics", "properties", "features",
                    "what does", "meaning of"]),
]
QUERY_CLASSES = [
    ("definition", ["what is", "define", "explain", "meaning of"]),
    ("relationship", ["how", "why", "relationship", "affect"]),
    ("latest", ["latest", "recent", "current", "2024", "2025", "2026"]),
    ("comparison", ["compare", "difference", "versus", "vs"]),
    ("factual", ["when", "where", "who"]),
]
INFORMATION_NEEDS = {
    "numerical_question": ["plqy", "efficiency", "pce", "%", "how much", "value", "temperature", "mobility",
                           "conductivity", "voc", "jsc", "ff", "bandgap"],
    "method_question": ["how", "fabricated", "prepared", "method", "process", "procedure", "synthesis", "deposit",
                        "coat", "anneal"],
    "comparison_question": ["compare", "difference", "versus", "vs", "better", "worse", "higher", "lower"],
    "definition_question": ["what is", "define", "definition", "meaning", "explain"],
}
PRIORITY_SECTIONS = {
    "numerical_question": ["results", "performance", "experimental", "characterization"],
    "method_question": ["methodology", "experimental", "fabrication"],
    "comparison_question": ["results", "discussion", "performance"],
}
EXPECT_NUMBERS = ["plqy", "efficiency", "pce", "%", "value", "how much", "temperature", "mobility"]
EXPECT_SEVERAL = [" and ", " s ", " are "]
EXPECT_METHOD = ["how", "fabricated", "prepared", "method", "process", "procedure"]
EXPECT_COMPARISON = ["compare", "difference", "versus", "vs", "better"]
NUMERIC_QUERY_WORDS = ["plqy", "efficiency", "%", "pce", "value", "temperature"]
STOP_WORDS = [
    "what", "how", "why", "when", "where", "which", "who", "is", "are", "was", "were", "be", "been", "being", "the",
    "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "can",
]
VIEW_STOP_WORDS = STOP_WORDS + ["could"]

# --- fixed values: retrieval, fusion, reflection -----------------------------------------------------------------
VECTOR_TOP_K = 20
RERANK_TOP_N = 8
KG_MAX_ENTITIES = 10
MAX_CONTEXTS = 20
MAX_WEB_CONTEXTS = 10
MIN_SIMILARITY = 0.30
MIN_SIMILARITY_RELAXED = 0.25
CONTEXT_BUDGET = 4000
TRUNCATION_NOTE = "\n[... Additional contexts truncated due to length ...]"
PROVIDER_BASE_SCORES = {
    "arxiv": 0.80, "pubmed": 0.78, "semantic_scholar": 0.76, "core": 0.72, "duckduckgo": 0.66,
}
PROVIDER_DEFAULT_SCORE = 0.62
QUALITY_THRESHOLD = 0.7
EARLY_STOP = 0.9
MAX_ROUNDS = 3
GAP_NUMBER_WORDS = ["how much", "how many", "efficiency", "percent", "%", "value", "yield", "quantum", "mobility",
                    "stability", "temperature", "wavelength", "nm", "ev", "cm²", "degree", "°c"]
GAP_COMPARISON_WORDS = ["compare", "comparison", "difference", "versus", "vs", "higher", "lower", "better", "worse",
                        "than"]
GAP_ENTITY_WORDS = ["what", "which", "materials", "devices", "methods"]
GAP_RELATION_WORDS = ["how", "why", "relationship", "affect", "improve"]
CAUSAL_WORDS = ["because", "due to", "results in", "leads to", "causes", "affects"]
EVIDENCE_UNITS = [NUMBER_UNITS[0], NUMBER_UNITS[1], NUMBER_UNITS[2], NUMBER_UNITS[3], NUMBER_UNITS[5],
                  NUMBER_UNITS[8]]
ANSWER_UNITS = EVIDENCE_UNITS[:5]
EVIDENCE_METHODS = [
    r"(?:by|using|via)\s+([a-z\-]+(?:\s+[a-z\-]+){0,3})\s+method",
    r"(?:by|using|via)\s+([a-z\-]+(?:\s+[a-z\-]+){0,2})\s+(?:process|technique|approach)",
    r"([a-z\-]+\s+vapor-diffusion)",
    r"([a-z\-]+\s+evaporation)",
    r"(spin\s+coating)",
    r"(thermal\s+annealing)",
]

# --- fixed values: evaluation ------------------------------------------------------------------------------------
METRICS = ["faithfulness", "answer_correctness", "context_recall", "context_precision", "answer_similarity",
           "answer_relevancy"]
MODES = ["direct_llm", "agentic_no_kg", "agentic_with_kg"]
MODE_LABELS = {"direct_llm": "direct", "agentic_no_kg": "no_kg", "agentic_with_kg": "with_kg"}
CORRECTNESS_THRESHOLD = 0.4
BREAKDOWN_THRESHOLD = 0.8
ANSWER_ERROR_MARKS = ["error generating answer", "error:", "failed to generate", "exception:",
                      "'nonetype' object has no attribute"]
ERROR_FIELD_MARKS = ["<!doctype", "<html", "429", "rate", "limit", "connection", "timeout", "network"]
FACT_MEANS = ["factual_correctness", "key_facts_coverage", "fact_accuracy", "fact_precision", "fact_recall",
              "hallucination_rate", "context_supported_rate"]
FACT_SUMS = ["critical_errors", "moderate_errors", "minor_errors"]
SEMANTIC_WEIGHT = 0.4
JUDGE_WEIGHT = 0.6

# --- fixed values: question-answer sets ---------------------------------------------------------------------------
QA_CATEGORIES = [
    "Materials Design & Synthesis",
    "Performance Metrics",
    "Structure-Property Relationships",
    "Device Architecture & Physics",
    "Processing & Fabrication",
    "Characterization Methods",
    "Stability & Degradation",
    "Computational & Machine Learning",
]
DIFFICULTIES = ["easy", "medium", "hard"]
REASONING_TYPES = ["single-hop", "multi-hop"]
QUESTION_HEADERS = {
    "question": ["Question", "Validation Question", "Research_Question", "question"],
    "expected_answer": ["Expected Answer", "Expected_Answer", "expected_answer", "answer", "Answer"],
    "paper_reference": ["Paper Reference (Title + Section + Excerpt)", "paper_reference"],
    "question_id": ["Question ID", "question_id", "ID"],
    "pdf_filename": ["PDF_Filename"],
    "topic": ["Topic"],
}
EXCERPT = r'(?s)Excerpt:\s*["“”]([^"“”]+)["“”]'

# --- fixed values: device records ----------------------------------------------------------------------------------
# Process columns of a device record that become properties of its vertex.
DEVICE_PROPERTIES = [
    "da_ratio", "donor_conc_mg_ml", "acceptor_conc_mg_ml", "additive_conc_mg_ml", "additive_vol_pct", "additive_wt_pct",
    "solvent_main", "solvent_second", "solvent_ratio", "total_conc_mg_ml", "spin_speed_rpm", "film_thickness_nm",
    "anneal_temp_c", "anneal_time_min", "anneal_atmosphere", "device_structure",
]

DEVICE_METRICS = [
    ("pce_percent", "Power Conversion Efficiency", "%"),
    ("jsc_ma_cm2", "Short-Circuit Current Density", "mA/cm^2"),
    ("voc_v", "Open-Circuit Voltage", "V"),
    ("ff", "Fill Factor", ""),
]


def heading_pattern(family: str) -> str:
    """One alternation for a heading family, to be matched where a line begins."""
    plain, numbered, hashed, hashed_numbered = SECTION_HEADINGS[family]
    parts = ["(?:" + "|".join(plain) + ")"]
    if numbered:
        parts.append(r"[0-9]+\.?\s*(?:" + "|".join(numbered) + ")")
    parts.append(r"#+\s*(?:" + "|".join(hashed) + ")")
    if hashed_numbered:
        parts.append(r"#+\s*[0-9]+\.?\s*(?:" + "|".join(hashed_numbered) + ")")
    if family == "references":
        parts += REFERENCE_LINE_STARTS
    return "(?:" + "|".join(parts) + ")"
