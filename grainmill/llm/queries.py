"""One query per operator over the test tables, with SQL where SQL can express the result."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import coder, hardneg, licenses, lines, manifest, mixing, neardup, packing, pii, quality, substring, topk, urls
from grainmill.session import fresh_path
from grainmill.sources.tables import Tables

QUERIES = {}
SQL = {}


#: Where this package lies; Python workers that see the same files import it from there.
HOME = str(Path(__file__).resolve().parents[2])


def offer(spark: SparkSession) -> None:
    """Puts the package on the import path of Python workers (a cluster of separate machines gets it by --py-files)."""
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if HOME not in now.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{HOME}:{now}".rstrip(":")


def query(fn=None, *, sql: str | None = None):
    def keep(plan):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            offer(spark)
            return plan(Tables(spark, folder))

        QUERIES[plan.__name__] = run
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return keep(fn) if fn else keep


WORD = r"[^\x20\x09-\x0D]+"

MIX_SQL = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, ([5, 2, 1])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight,
         2 * source_size as cap, 1.5::double * (sum(source_size) over ())::bigint as total
  from sources
), ordered as (
  select *, row_number() over w as r,
         coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as closed,
         (sum(weight) over (w rows between current row and unbounded following))::bigint as open
  from weighed window w as (order by cap::double / weight, source is null, source)
), level as (
  select coalesce((select (total - closed) / open from ordered
    where cap > weight * ((total - closed) / open) order by r limit 1), 0.0::double) as lvl
), targets as (
  select source, source_size, case when cap > weight * lvl then weight * lvl else cap::double end as target
  from weighed, level
), placed as (
  select sized.*, source_size, target,
         (sum(size) over (partition by sized.source order by k, doc_id rows unbounded preceding))::bigint - size as before,
         case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
       (size * epochs + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
from placed
"""


@query(sql=MIX_SQL)
def op3_mix_sources(t: Tables) -> DataFrame:
    return mixing.mix_sources(t.documents).drop("body")


@query
def op6_quality_bands(t: Tables) -> DataFrame:
    return quality.quality(t.documents.select("doc_id", "text")).drop("text")


LINES_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), owned as (
  select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from keyed
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from owned group by doc_id
"""


@query(sql=LINES_SQL)
def op10_line_dedup(t: Tables) -> DataFrame:
    kept = lines.drop_repeated_lines(t.documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op1_pack_documents(t: Tables) -> DataFrame:
    packed = packing.pack(t.documents)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


TOP_SQL = """
with sound as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from sound q, sound c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
) where rank <= 5
"""


@query(sql=TOP_SQL)
def op2_top_inner_products(t: Tables) -> DataFrame:
    return topk.top_k(t.embeddings, every=50)


URL_SQL = r"""
with named as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') as raw,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
  from pages
), lowered as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from named
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best as (
  select host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         max_by(verdict, length(rule_host || rule_path)) as verdict
  from (select distinct host, path from lowered) join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from lowered left join best using (host, path)
"""


@query(sql=URL_SQL)
def op5_url_filter(t: Tables) -> DataFrame:
    """The SQL leaves out redirects: no page of these tables has one. Tests hold them against brute force."""
    return urls.judge(t.pages)


@query
def op7_substring_dedup(t: Tables) -> DataFrame:
    return substring.repeated_spans(t.documents).drop("body")


NEAR_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
         else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words
), classes as (
  select min(doc_id) as rep, k, n from (select doc_id, md5(array_to_string(list_sort(s), chr(10))) as k, len(s) as n from sets)
  where n > 0 group by k, n
), long as (
  select rep, n, unnest(s) as x from classes join sets on rep = doc_id
), pairs as (
  select p.rep as a, q.rep as b, p.n + q.n as total, count(*) as common
  from long p join long q on p.x = q.x and p.rep < q.rep and least(p.n, q.n) * 100 >= greatest(p.n, q.n) * 80
  group by p.rep, q.rep, p.n, q.n
), links as (
  select a, b from pairs where 100 * common >= 80 * (total - common)
), ends as (
  select a, b from links union all select b, a from links
), reached as (
  select rep as a, rep as b from classes
  union
  select reached.a, ends.b from reached join ends on reached.b = ends.a
), smallest as (
  select a as rep, min(b) as component from reached group by a
), named as (
  select doc_id, len(s)::bigint as n_shingles, md5(array_to_string(list_sort(s), chr(10))) as k from sets
)
select doc_id, n_shingles, coalesce(component, doc_id)::bigint as component_id,
       coalesce(component, doc_id) = doc_id as kept
from named left join classes on named.k = classes.k and n_shingles = n left join smallest using (rep)
"""


@query(sql=NEAR_SQL)
def op9_near_duplicates(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents, width=2)


@query
def op4_pii(t: Tables) -> DataFrame:
    found = pii.find_pii(t.documents)
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.spelled("base_spans"), 256).alias("base_sha256"),
        pii.spelled("spans").alias("spans"),
    )


@query
def op8_token_files(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "tokens")
    coder.write_tokens(t.documents, path)
    found = coder.read_tokens(t.spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


MERKLE_SQL = r"""
with recursive spelt as (
  select row_number() over () as r, doc_id, source, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as front, text,
         list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
           lambda c, b: list_reduce(range(8), lambda a, i: xor(a >> 1, (a & 1) * 3988292384), xor(c, b)), 4294967295) & 1 as odd
  from documents
), leaves as (
  select *, sha256(front || coalesce(strlen(text) || ':' || text, '-')) as leaf, case when odd = 1 then
           sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end as changed
  from spelt
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as i from leaves
), up as (
  select source, 0 as l, i as j, leaf as h, count(*) over (partition by source) as c from placed
  union all
  select source, l + 1, j // 3, sha256(string_agg(h, '' order by j)), (c + 2) // 3 from up where c > 1 group by source, l, j // 3, c
), subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as t from up where c = 1
), top as (
  select 0 as l, t as j, subroot as h, count(*) over () as c from subroots
  union all
  select l + 1, j // 3, sha256(string_agg(h, '' order by j)), (c + 2) // 3 from top where c > 1 group by l, j // 3, c
), runs as (
  select source, l, j // 3 as p, list(h order by j) as run from up where c > 1 group by all
), top_runs as (
  select l, j // 3 as p, list(h order by j) as run from top where c > 1 group by all
), below as (
  select r, source, i as j, 0 as l, coalesce(changed, leaf) as now, '' as proof from placed
  union all
  select r, below.source, j // 3, below.l + 1,
         sha256(array_to_string(run[:j % 3], '') || now || array_to_string(run[j % 3 + 2:], '')),
         proof || array_to_string(run[:j % 3], '') || array_to_string(run[j % 3 + 2:], '')
  from below join runs on below.source is not distinct from runs.source and below.l = runs.l and j // 3 = p
), inside as (
  select r, source, max_by(now, l) as now, max_by(proof, l) as proof from below group by r, source
), beyond as (
  select r, t as j, 0 as l, now, proof from inside join subroots on inside.source is not distinct from subroots.source
  union all
  select r, j // 3, beyond.l + 1, sha256(array_to_string(run[:j % 3], '') || now || array_to_string(run[j % 3 + 2:], '')),
         proof || array_to_string(run[:j % 3], '') || array_to_string(run[j % 3 + 2:], '')
  from beyond join top_runs on beyond.l = top_runs.l and j // 3 = p
), ends as (
  select r, max_by(now, l) as folded_root, sha256(max_by(proof, l)) as proof_sha256 from beyond group by r
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from placed join ends using (r) join subroots on placed.source is not distinct from subroots.source,
     (select h as root from top where c = 1)
"""


@query(sql=MERKLE_SQL)
def op13_merkle_manifest(t: Tables) -> DataFrame:
    fields = [F.col(c) for c in manifest.COLUMNS[:-1]]
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, manifest.leaf_digest([*fields, broken]))
    found = manifest.manifest(t.documents, carry={"broken": broken})
    end = manifest.folded(F.coalesce("broken", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        end.alias("folded_root"), (end == F.col("root")).alias("verified"),
    )


HARD_SQL = """
with sound as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.r as a, a.vec_id as anchor_id, c.r as c, c.vec_id, a.label = c.label as same,
         list_inner_product(a.v, c.v)::bigint as score
  from sound a join sound c on a.r <> c.r and len(a.v) = len(c.v) where a.vec_id % 100 = 0
), positives as (
  select a, anchor_id, c as p, vec_id as positive_id, score as positive_score from scored
  where same qualify row_number() over (partition by a order by score desc, vec_id) <= 5
)
select positives.anchor_id, positive_id, row_number() over w::int as rank, vec_id as negative_id, positive_score,
       score as negative_score
from positives join scored on positives.a = scored.a
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by positives.a, p order by score desc, vec_id)
qualify row_number() over w <= 10
"""


@query(sql=HARD_SQL)
def op11_hard_negatives(t: Tables) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(t.embeddings.select("vec_id", "embedding", label.alias("label")), every=100)


@query
def op12_license_scan(t: Tables) -> DataFrame:
    found = licenses.scan_licenses(t.documents)
    at = F.flatten(F.col("base.words"))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.transform(F.filter("spans", lambda s: s["sure"]), lambda s: s["label"])
    return found.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), named(F.col("base.label")).alias("base_labels"),
        named(F.concat(F.col("base.label"), sure)).alias("labels"), "score",
    )
