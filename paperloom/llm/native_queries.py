"""Queries of the operators that stay in the JVM: chat formatting and url filters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, decontam, secrets, urlrules
from paperloom.llm.registry import llm_query
from paperloom.sources.readers import table

PROBE = "\\### Assistant: </turn> ok"


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"


OP2_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
), marked as (
  select *, {_sql_escaped('text')} as body, {_sql_escaped('role')} as name,
         lag(role) over (partition by conv_id order by turn, role, text) as before
  from rows
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
       sum(length(body) + 13 + case when before is distinct from role then length(name) + 16 else 0 end)::bigint as formatted_chars
from marked group by conv_id
"""


@llm_query("op2_chat_formatting", OP2_SQL)
def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation formatted, and what reading the result back gives."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    out = chat.format_conversations(rows.unionByName(probe))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.getField("trained")), lambda t: t.getField("text")), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


# The rules of the contract, then the filter's own patterns.
SITES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
BAD_SITES = [
    ("spam", "farm"), ("cheap", "pills"), ("free", "casino"), ("click", "bait"), ("link", "farm"),
    ("casino", "win"), ("ads", "track"), ("free", "bets"), ("adult", "x"),
]
BAD_PATHS = ["login", "signin", "logout", "register", "cart", "checkout", "print", "search", "feed", "tag"]
BAD_FILES = ["exe", "zip", "jpg", "png", "gif", "mp4", "css", "js"]


def filter_rules() -> list[urlrules.Rule]:
    rules = [urlrules.site_rule(*s) for s in SITES]
    rules += [urlrules.Rule(f"site {a}-{b}", rf"^(?:[^/]*\.)?{a}-{b}\.[^/]*(?:/|$)", "block", (a, b)) for a, b in BAD_SITES]
    rules += [urlrules.Rule(f"path {p}", rf"/{p}(?:/|$)", "block", (p,)) for p in BAD_PATHS]
    rules += [urlrules.Rule(f"file {e}", rf"/[^/]*\.{e}$", "block", (e,)) for e in BAD_FILES]
    return rules


_SITE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in SITES)
_BAD = "|".join(
    [rf"^(?:[^/]*\.)?(?:{'|'.join('-'.join(s) for s in BAD_SITES)})\.[^/]*(?:/|$)", rf"/(?:{'|'.join(BAD_PATHS)})(?:/|$)", rf"/[^/]*\.(?:{'|'.join(BAD_FILES)})$"]
)
OP3_SQL = f"""
with rules(rule_host, rule_path, rule_verdict) as (values {_SITE_ROWS}),
p as (
  select page_id, row_number() over () as n,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlrules.UPPER}', '{urlrules.LOWER}'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), best as (
  select n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by n
)
select page_id, host, path, rule,
       coalesce(rule_verdict, case when regexp_matches(host || path, '{_BAD}') then 'block' else 'allow' end) as verdict
from p left join best using (n)
"""


@llm_query("op3_url_filters", OP3_SQL)
def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every page's url; ``rule`` names site rules only."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = urlrules.judge_urls(pages, filter_rules())
    sites = [h + p for h, p, _ in SITES]
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(*sites), F.col("rule")).alias("rule"), "verdict")


_WORDS = "regexp_extract_all(translate({}, '" + decontam.UPPER + "', '" + decontam.LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
with items as (select item_id, {_WORDS.format('text')} as w from benchmark where text is not null),
windows as (
  select distinct item_id, list_slice(w, i + 1, i + {decontam.N}) as win
  from (select item_id, w, unnest(range(0, greatest(len(w) - {decontam.N}, 0) + 1)) as i from items where len(w) > 0)
), docs as (select row_number() over () as r, doc_id, coalesce({_WORDS.format('text')}, []) as w from documents),
spots as (select r, w, unnest(range(0, len(w))) as i from docs),
lengths as (select distinct len(win) as k from windows),
probes as (select r, i, k, list_slice(w, i + 1, i + k) as win from spots, lengths where i + k <= len(w)),
hits as (select r, i, k, item_id from probes join windows using (win)),
covered as (select r, count(distinct i + d) as n_hit from (select distinct r, i, unnest(range(0, k)) as d from hits) group by r),
found as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hits) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join found using (r)
"""


@llm_query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """What every document shares with the benchmark items."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf, "benchmark").select("item_id", "text"))
    n_hit = decontam.covered(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _sql_spans(kind: str) -> str:
    p = secrets.PATTERNS[kind].replace("'", "''")
    kept = {
        "assign": f"length(regexp_extract(m, '{p}', 1)) >= {secrets.MIN_VALUE}",
        "weak_secret": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')",
    }.get(kind, "true")
    return f"""
  select r, {secrets.KINDS.index(kind)} as k, start_at as s, start_at + length(m) as e from (
    select r, ms[i] as m,
           (list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))::bigint as start_at
    from (select *, unnest(range(1, len(ms) + 1)) as i
          from (select r, regexp_extract_all(text, '{p}') as ms, string_split_regex(text, '{p}') as ps from d))
  ) where {kept}"""


_NAMES = "['" + "', '".join(secrets.KINDS) + "']"
OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
base as ({' union all '.join(_sql_spans(k) for k in secrets.STRONG)}),
weak as (
  select * from ({' union all '.join(_sql_spans(k) for k in secrets.WEAK)}) w
  where not exists (select 1 from base b where b.r = w.r and b.s < w.e and w.s < b.e)
), parts as (select *, case when k in (1, 3) then 'id' when k = 5 then 'at' else 'key' end as role from (select * from base union all select * from weak)),
linked as (
  select r, k, s, e from (
    select w.r, w.k, w.s, w.e, bool_or(p.role = 'id') as has_id, bool_or(p.role = 'key') as has_key
    from weak w join parts p on p.r = w.r and p.s - {secrets.SCOPE} <= w.e and w.s <= p.e + {secrets.SCOPE}
    group by all
  ) where case k when 3 then has_key when 4 then has_id else has_id and has_key end
),
b as (
  select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
         string_agg({_NAMES}[k + 1] || ':' || s || ':' || e, ',' order by s, k) as base
  from base group by r
), a as (
  select r, string_agg({_NAMES}[k + 1] || ':' || s || ':' || e, ',' order by s, k) as spans
  from (select r, k, s, e from base union all select r, k, s, e from linked) group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join b using (r) left join a using (r)
"""


@llm_query("op7_secret_scans", OP7_SQL)
def op7_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The secrets in every document."""
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))

    def count(kind: str):
        k = secrets.KINDS.index(kind)
        return F.size(F.filter("base_spans", lambda s: s.getField("k") == k)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in secrets.STRONG], F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.written(F.col("all_spans")).alias("spans"),
    )
