"""The operators of this subpackage as registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chroma, decontam, divergence, lines, minimax, mixing, oddsketch, quality, secrets, substrings, toxicity, warc, whitening
from loomgraph.plans.shared import shared_folder, table


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the UTF-8 bytes of ``documents.text`` are read as 8-bit PCM. Queries are the ids divisible by 100."""
    found = chroma.align(table(spark, sf_dir, "documents"), F.encode("text", "UTF-8"), F.col("doc_id") % 100 == 0, form=chroma.SHORT)
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["equal"]).alias("v"), m["errors"].alias("errors"), m["query_id"].alias("query_id"), m["offset"].alias("offset"))))
    return found.select("doc_id", "recording", "n_items", F.size(F.array_distinct("matches.query_id")).alias("n_matches"), F.size("matches").alias("n_passages"), best["query_id"].alias("best_query"), best["offset"].alias("best_offset"), best["errors"].alias("bit_errors"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax.minimax_shards(table(spark, sf_dir, "documents"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_runs(table(spark, sf_dir, "documents"), least=3)
    longest = F.array_max(F.transform("runs", lambda r: r["to_line"] - r["from_line"]))
    return found.select("doc_id", "n_lines", "n_removed", "depth", F.size("runs").alias("n_runs"), F.coalesce(longest, F.lit(0)).alias("longest_run"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/loomgraph-warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).filter("quarantined is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size(F.array_distinct("hits.item_id")).alias("n_items"), F.array_min("hits.item_id").alias("first_item"), F.array_min("hits.distance").alias("least_distance"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


def op8_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, part=85, whole=100)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("evidence").alias("n_neighbours"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_ranking, op2_chroma_alignment, op3_minimax_shards, op4_line_runs, op5_warc_salvage, op6_benchmark_decontamination, op7_mix_sources, op8_odd_sketch_near_dedup, op9_substring_dedup, op10_toxicity_neighbours,
    op11_whitened_embeddings, op12_source_divergence, op13_linked_secrets,
)}

_HEX32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::bigint >> {15 - 5 * d}) & 31), 1)" for k in range(8) for d in range(4)
)



def _either_case(pattern: str) -> str:
    """A pattern whose letters outside of classes and escapes stand for both cases."""
    return re.sub(r"\\x..|\\.|\[[^]]*\]|[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]" if len(m[0]) == 1 else m[0], pattern.removeprefix("(?i)"))


def _secrets_sql() -> str:
    """The matches of each kind with their places; spans; identifiers with what lies in their reach; parts of credentials."""
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "identifier": secrets.IDENTIFIER, "value": secrets.VALUE, "endpoint": secrets.ENDPOINT, "break": secrets.BREAK}
    one = """select r, {k} as kind, i, m, sum(length(b) + length(m)) over (partition by r order by i) as e, {ok} as ok from (select r, unnest(range(len(m))) as i, unnest(m) as m, unnest(b[:len(m)]) as b, unnest(g) as g
        from (select r, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as b, regexp_extract_all(t, '{p}', {group}) as g from d))"""
    ok = {"assign": f"length(g) >= {secrets.ASSIGN_LEAST}", "value": "regexp_matches(m, '[:=]') or length(m) = 40 and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')"}
    cased = {n: (_either_case(p) if p.startswith("(?i)") else p).replace("'", "''") for n, p in patterns.items()}
    matches = " union all ".join(one.format(k=k, p=p, ok=ok.get(n, "true"), group=2 if n == "assign" else 0) for k, (n, p) in enumerate(cased.items()))
    label = "['assign', 'access', 'hex', 'identifier', 'value', 'endpoint'][kind + 1]"
    return f"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        x as (select r, kind, e - length(m) as s, e from ({matches}) where ok),
        y as (select *, count(*) filter (kind = 6) over p as scope, max(e) filter (kind <= 2) over p as ended, min(s) filter (kind <= 2) over (partition by r order by s, kind rows between current row and unbounded following) as begins
              from x window p as (partition by r order by s, kind rows between unbounded preceding and current row)),
        f as (select r, kind, s, e, scope from y where kind <= 2 or kind < 6 and not coalesce(ended > s or begins < e, false)),
        l as (select a.r, a.kind as k, a.s as f, b.kind, b.s from f a join f b on a.r = b.r and a.scope = b.scope and a.kind in (1, 3) and b.kind in (0, 2, 4, 5) and b.s >= a.s - {secrets.REACH} and b.e <= a.e + {secrets.REACH}),
        c as (select r, k, f from l group by all having bool_or(kind <> 5) and bool_or(kind = 5 or kind in (0, 2) or k = 1)),
        w as (select r, k as kind, f as s from c union select r, kind, s from l semi join c using (r, k, f)),
        a as (select r, kind, s, {label} || ':' || s || ':' || e as span from f where kind <= 2 or (r, kind, s) in (select (r, kind, s) from w)),
        g as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(span, ',' order by s, kind) filter (kind <= 2) as base, string_agg(span, ',' order by s, kind) as spans from a group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)"""


ORACLE: dict[str, str] = {
    "op12_source_divergence": f"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        w as (select r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from (select r, lang, source, unnest(regexp_extract_all(text, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) as t from d)),
        k as (select lang, term, count(*) as qn from w group by lang, term having count(distinct r) >= {divergence.LEAST_DOCS}),
        l as (select lang, count(*) as v, sum(qn) as qt from k group by lang),
        c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
        g as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by all),
        a as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (qn + 5)) // (qt + 5 * v) as q
              from g join k using (lang) join l using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        s as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source
              left join a x on x.lang = g.lang and x.source = g.source left join a y on y.lang = h.lang and y.source = h.source and y.term = x.term group by all
              union all select lang, source, 'term', term, (p - q)::bigint from a where n > 0 and p > q)
        select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from s qualify part = 'pair' or rank <= {divergence.TOP}""",
    "op13_linked_secrets": _secrets_sql(),
    "op4_line_runs": """
        with t as (select doc_id, text, string_split(text, chr(10)) as l from documents),
        x as (select doc_id, unnest(l) as content, unnest(range(len(l))) as line, len(l) as n from t),
        w as (select doc_id, line, n, content, lead(content, 1) over v as c1, lead(content, 2) over v as c2 from x window v as (partition by doc_id order by line)),
        f as (select *, row_number() over (partition by content, c1, c2 order by doc_id, line) as k from w where line + 2 < n),
        g as (select distinct doc_id, line + o as line from f, range(3) as r(o) where k > 1),
        k as (select x.doc_id, x.line, x.content, g.line is not null as gone from x left join g on x.doc_id = g.doc_id and x.line = g.line),
        i as (select doc_id, line - row_number() over (partition by doc_id order by line) as island from g),
        r as (select doc_id, count(*) as n_runs, max(size) as longest_run from (select doc_id, island, count(*) as size from i group by all) group by doc_id),
        h as (select 3 * (1 << e) as h from range(14) as u(e)),
        s as (select x.doc_id, x.line, h, md5(array_to_string(list_slice(t.l, x.line + 1, x.line + h), chr(10))) as m from x join t using (doc_id) join h on x.line + h <= x.n where (x.doc_id, x.line) in (select (doc_id, line) from f where k > 1 or (content, c1, c2) in (select (content, c1, c2) from f where k = 2))),
        p as (select doc_id, h, row_number() over (partition by h, m order by doc_id, line) as k from s),
        d2 as (select doc_id, max(h) as depth from p where k > 1 group by doc_id)
        select d.doc_id, coalesce(max(len(t.l)), 0) as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed, coalesce(max(d2.depth), 0)::int as depth,
               coalesce(max(r.n_runs), 0)::int as n_runs, coalesce(max(r.longest_run), 0)::int as longest_run,
               case when max(d.text) is not null then sha256(coalesce(string_agg(k.content, chr(10) order by k.line) filter (where not gone), '')) end as kept_sha256
        from documents d left join t on d.doc_id = t.doc_id left join k on d.doc_id = k.doc_id left join r on d.doc_id = r.doc_id left join d2 on d.doc_id = d2.doc_id group by d.doc_id""",
    "op5_warc_salvage": f"""
        with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
        f as (select h, min(page_id) as first from p group by h)
        select page_id, strlen(payload) as payload_bytes, {_HEX32} as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from p join f using (h)""",
}
