"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    codebooks, decontamination, html_text, language_id, licenses, merkle, minhash, packing, quality, secrets, sharding,
    suffix_dedup, token_counts,
)
from .common import LOWER, UPPER, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
bw as (
  select item_id, least(len(w), 10) as n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) as win
  from b where len(w) > 0),
lens as (select distinct n from bw),
dw as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, w from d, lens where len(w) >= n),
hits as (
  select doc_id, p, dw.n, item_id from dw join bw on dw.n = bw.n and list_slice(w, p, p + dw.n - 1) = win),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query(_OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, found again in flat token files made from them."""
    found = token_counts.named_counts(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


_OP7_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: list_slice(w, i, i + least(len(w), 4) - 1))) as g
  from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select u, v from shared join n a on u = a.doc_id join n b on v = b.doc_id where 100 * common >= 80 * (a.n + b.n - common)),
walk as (select u, v from links union select w.u, l.v from walk w join links l on w.v = l.u),
reach as (select u, min(v) as low from walk group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from d left join n using (doc_id) left join reach on d.doc_id = reach.u
"""


@query(_OP7_SQL)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


_OP9_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as ls from d),
win as (
  select doc_id, p, list_slice(w, p, p + 7) as win
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from w where len(w) >= 8)),
rep as (select doc_id, p from win qualify count(*) over (partition by doc_id, win) > 1),
rw as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + 8)) as q from rep) group by 1),
stats as (
  select doc_id, source, t, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words
  from w left join rw using (doc_id)),
ln as (
  select doc_id, source, t, trim(regexp_replace(unnest(string_split(lower(t), chr(10))), '[\x20\x09-\x0D]+', ' ', 'g')) as line
  from d),
lw as (select *, len(string_split(line, ' ')) as nw from ln where line <> ''),
sizes as (select source, count(distinct t) as n_of from lw group by 1),
freq as (
  select source, line from lw join sizes using (source) group by source, line, n_of
  having count(distinct t) > 100 and count(distinct t) * 100 > n_of * 5),
left_over as (
  select doc_id, sum(nw) as words, coalesce(sum(nw) filter (f.line is null), 0) as rest, count(f.line) as gone
  from lw left join freq f on lw.source = f.source and lw.line = f.line group by 1),
gone as (select doc_id from left_over where gone > 0 and rest < 5 and rest * 100 < words * 20)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and doc_id not in (select doc_id from gone) as kept
from stats
"""


@query(_OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("depleted")



@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no repositories: a source is an owner, its languages are its repositories."""
    repository = F.concat_ws("/", "source", "lang")
    found = secrets.scan(read(spark, sf_dir, "documents"), repository=repository)
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.spans_text("base"), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans"),
        "n_live",
        "n_example",
    )


_OP12_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar), '-')"
_OP12_LEAF = "sha256(" + " || ".join(_OP12_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_OP12_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of `bytes`, a list of byte values, four bits at a time.
_NIBBLES = """nibble as (select list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0],
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as nib)"""
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(hex(encode({0})), '..'),
    lambda x: [('0x' || x[2])::bigint, ('0x' || x[1])::bigint]))), lambda c, x: xor(c >> 4, nib[(xor(c, x) & 15) + 1])), 4294967295)"""


def _climb_sql(name: str, leaves: str) -> str:
    """Recursive query over nodes (tree, level, idx, total, digest) of trees of runs of eight."""
    return f"""{name} as (
  select tree, 0 as level, idx, total, digest from {leaves}
  union all
  select tree, level + 1, idx // 8, (total + 7) // 8, sha256(string_agg(digest, '' order by idx))
  from {name} where total > 1 group by tree, level, idx // 8, total)"""


def _siblings_sql(name: str, nodes: str) -> str:
    """Per node and level: what stands left and right of it in its run."""
    return f"""{name} as (
  select a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as lefts,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as rights
  from {nodes} a left join {nodes} b on a.tree = b.tree and a.level = b.level and a.idx // 8 = b.idx // 8 and a.idx <> b.idx
  where a.total > 1 group by 1, 2, 3)"""


_OP12_SQL = f"""
with recursive {_NIBBLES},
docs as (
  select doc_id, coalesce('1' || lang, '0') as tree, {_OP12_LEAF.format('text')} as leaf,
    case when {_CRC.format('cast(doc_id as varchar)')} % 3 = 0 then {_OP12_LEAF.format(_OP12_LOWER)} else {_OP12_LEAF.format('text')} end as claimed
  from documents, nibble),
leaves as (
  select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as idx, count(*) over (partition by tree) as total, leaf as digest
  from docs),
{_climb_sql('nodes', 'leaves')},
subroots as (
  select tree as lang_tree, digest, row_number() over (order by encode(tree)) - 1 as idx, count(*) over () as total, 'top' as tree
  from nodes where total = 1),
{_climb_sql('tops', 'subroots')},
{_siblings_sql('beside', 'nodes')},
{_siblings_sql('beside_top', 'tops')},
steps as (
  select doc_id, level, lefts, rights from leaves l join beside b on b.tree = l.tree and b.idx = l.idx // (8 ** level)::bigint
  union all
  select doc_id, 1000 + level, lefts, rights from leaves l join subroots s on s.lang_tree = l.tree
    join beside_top b on b.idx = s.idx // (8 ** level)::bigint),
ways as (select doc_id, list(struct_pack(l := lefts, r := rights) order by level) as way from steps group by 1),
fold as (
  select doc_id, 1 as k, claimed as now, coalesce(way, []) as way from leaves left join ways using (doc_id)
  union all
  select doc_id, k + 1, sha256(way[k].l || now || way[k].r), way from fold where k <= len(way))
select doc_id, leaf, s.digest as subroot, r.digest as root,
  sha256(coalesce(array_to_string(list_transform(way, lambda w: w.l || w.r), ''), '')) as proof_sha256,
  now as folded_root, now = r.digest as verified
from leaves join subroots s on s.lang_tree = leaves.tree join fold using (doc_id) join (select digest from tops where total = 1) r on true
where k = len(way) + 1
"""


@query(_OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proved against the manifest; where 3 divides the id's checksum, as one whose text was lowered."""
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = merkle.leaf(*fields, F.translate("text", UPPER, LOWER))
    proved, _ = merkle.manifest(docs, [*fields, F.col("text")], F.col("lang"), F.when(changed, lowered))
    return proved


def _op13_draw(name: str, weight: float) -> str:
    digest = f"md5('{sharding.SEED}:' || {name} || coalesce(':' || cast(doc_id as varchar), ''))"
    return f"-ln(1.0 - ('0x' || substr({digest}, 1, 13))::bigint / 4503599627370496.0::double) / {weight}::double"


_OP13_SQL = f"""
with {_NIBBLES},
docs as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, {_CRC.format("coalesce(text, '')")} as text_crc32 from documents, nibble),
regions as (
  select *, {_op13_draw("'region-' || region", 8)} as score, {_op13_draw("'added-24'", 1)} as added
  from docs, (select unnest(range(3)) as region)),
first_region as (select doc_id, arg_min(region, score) as region, min(score) as score, min(added) as added from regions group by 1),
racks as (
  select *, {_op13_draw("'region-' || region || '/rack-' || rack", 4)} as rack_score
  from (select *, unnest(range(2 * region, 2 * region + 2)) as rack from first_region)),
first_rack as (select doc_id, region, arg_min(rack, rack_score) as rack, min(score) as score, min(added) as added from racks group by 1, 2),
shards as (
  select *, {_op13_draw("'region-' || region || '/rack-' || rack || '/' || shard", 1)} as shard_score
  from (select *, unnest(range(4 * rack, 4 * rack + 4)) as shard from first_rack)),
placed as (select doc_id, arg_min(shard, shard_score) as shard, min(added) < min(score) as moves from shards group by 1)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot,
  case when moves then 24 else shard end as grown_shard
from docs join placed using (doc_id)
"""


@query(_OP13_SQL)
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal weight, and where they lie with one more."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"), sharding.Tree.even(24))


def _op11_nearest(name: str, book: str) -> str:
    """Per vector and part the nearest entry, as distance * 64 + entry."""
    square = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 5))
    return f"""{name} as materialized (select vec_id, p, any_value(x) as x, min(({square}) * 64 + e) as best
  from parts join {book} using (p) group by 1, 2)"""


def _op11_means(name: str, nearest: str, book: str) -> str:
    mean = ", ".join(f"(sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
    return f"""{name}_means as (select p, best % 64 as e, [{mean}] as m from {nearest} group by 1, 2),
{name} as materialized (select p, e, coalesce(m, c) as c from {book} left join {name}_means using (p, e))"""


_OP11_SQL = f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as z
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, z[4 * p + 1 : 4 * p + 4] as x from v, (select unnest(range(16)) as p)),
book0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts
  where vec_id in (select vec_id from v order by vec_id limit 64)),
{_op11_nearest('near0', 'book0')},
{_op11_means('book1', 'near0', 'book0')},
{_op11_nearest('near1', 'book1')},
{_op11_means('book2', 'near1', 'book1')},
{_op11_nearest('near2', 'book2')},
coded as (
  select vec_id, string_agg(lower(printf('%02x', (best % 64)::int)), '' order by p) as code, sum(best // 64)::bigint as error
  from near2 group by 1),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from v join coded using (vec_id), books
"""


@query(_OP11_SQL)
def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 16 two-digit codes, with codebooks fitted in two rounds."""
    coded, books = codebooks.compress(read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))
