"""What a question asks for, as column functions over a question table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import any_of, has_any, literal_map


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(v.WORDS), F.lit(0))


def first_hit(rules: list[tuple[str, Column]], default: str) -> Column:
    out = F.lit(default)
    for label, test in reversed(rules):
        out = F.when(test, label).otherwise(out)
    return out


def question_type(c: Column) -> Column:
    return first_hit([(label, has_any(c, words)) for label, words in v.QUESTION_TYPES], "general")


def whole_words(words: list[str]) -> str:
    return f"{v.WORD_START}(?:{any_of(words)}){v.WORD_END}"


def query_class(c: Column) -> Column:
    low = F.lower(c)
    return first_hit([(label, low.rlike(whole_words(words))) for label, words in v.QUERY_CLASSES], "general")


def information_needs(c: Column) -> dict[str, Column]:
    return {name: has_any(c, words) for name, words in v.INFORMATION_NEEDS.items()}


def retrieval_parameters(c: Column, top_k: int = v.VECTOR_TOP_K, top_n: int = v.RERANK_TOP_N) -> dict[str, Column]:
    """k, rerank size and preferred sections; the first need that holds decides."""
    needs = information_needs(c)
    num, method, comp = (needs[n] for n in ("numerical_question", "method_question", "comparison_question"))

    def pick(a, b, d, other):
        return F.when(num, a).when(method, b).when(comp, d).otherwise(other)

    sections = {n: F.array(*[F.lit(s) for s in names]) for n, names in v.PRIORITY_SECTIONS.items()}
    return {
        "vector_top_k": pick(F.lit(max(20, top_k)), F.lit(15), F.lit(max(20, top_k)), F.lit(top_k)),
        "reranker_top_n": pick(F.lit(max(8, top_n)), F.lit(5), F.lit(max(8, top_n)), F.lit(top_n)),
        "kg_max_entities": F.lit(v.KG_MAX_ENTITIES),
        "prioritize_sections": pick(
            sections["numerical_question"],
            sections["method_question"],
            sections["comparison_question"],
            F.array().cast("array<string>"),
        ),
    }


def select_sources(
    c: Column,
    round_no: Column | int = 1,
    use_kg: bool = True,
    use_reranker: bool = True,
    use_web: bool = True,
    web_from_round: int = 1,
) -> Column:
    """Sources to ask.  The web joins for recent, definition and general questions, from a given round on."""
    cls = query_class(c)
    recent = F.lower(c).rlike(whole_words(dict(v.QUERY_CLASSES)["latest"]))
    web = (cls.isin("latest", "definition", "general") | recent) & (F.lit(round_no) >= max(1, web_from_round))
    names = [F.lit("vector")]
    if use_kg:
        names.append(F.lit("kg"))
    if use_reranker:
        names.append(F.lit("reranker"))
    if use_web:
        names.append(F.when(web, "web"))
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def _full_names() -> Column:
    return literal_map((short, names[0]) for short, names in v.ABBREVIATIONS.items())


def key_terms(c: Column) -> Column:
    """Full names of known abbreviations and words of more than three letters, each once, in text order."""
    full = _full_names()
    terms = F.filter(
        F.transform(tokens(c), lambda w: F.coalesce(F.try_element_at(full, w), F.when(F.length(w) > 3, w))),
        lambda t: t.isNotNull(),
    )
    low = F.transform(terms, F.lower)
    return F.filter(terms, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def expand_abbreviations(c: Column) -> Column:
    full = _full_names()
    names = F.filter(F.transform(tokens(c), lambda w: F.try_element_at(full, w)), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.concat(c, F.lit(" "), F.array_join(names, " "))).otherwise(c)


def enhanced_query(c: Column) -> Column:
    terms = key_terms(c)
    return F.when(F.size(terms) > 0, F.concat(c, F.lit(" "), F.array_join(terms, " "))).otherwise(c)


def answer_expectations(c: Column) -> dict[str, Column]:
    numbers, comparison = has_any(c, v.EXPECT_NUMBERS), has_any(c, v.EXPECT_COMPARISON)
    return {
        "expects_numbers": numbers,
        "expects_method": has_any(c, v.EXPECT_METHOD),
        "expects_comparison": comparison,
        "number_count": F.when(comparison | (numbers & has_any(c, v.EXPECT_SEVERAL)), 2).otherwise(0),
    }


def keywords(c: Column, limit: int = 5, stop_words: list[str] = v.STOP_WORDS) -> Column:
    """First words of more than two letters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = F.filter(tokens(c), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.slice(words, 1, limit)
