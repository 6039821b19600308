"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rasterweave.llm import bpe, langid, licenses, lines, matroska, minhash, mixing, pii, spandedup, topk

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda s, d: langid.identify(_docs(s, d)),
        "op2_minhash_near_dedup": lambda s, d: minhash.near_duplicates(_docs(s, d)),
        "op3_bpe_codec": lambda s, d: bpe.digests(_docs(s, d)),
        "op4_license_scan": lambda s, d: licenses.scan(_docs(s, d)),
        "op5_matroska_media": lambda s, d: matroska.media_digests(_docs(s, d)),
        "op6_suffix_dedup": lambda s, d: spandedup.digests(_docs(s, d)),
        "op7_exact_top_k": lambda s, d: topk.top_k(s.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 50 == 0),
        "op8_pii": lambda s, d: pii.scan(_docs(s, d)),
        "op9_source_mixing": lambda s, d: mixing.shares(_docs(s, d)),
        "op10_line_dedup": lambda s, d: lines.digests(_docs(s, d), least=1),
        "pipeline": corpus_pipeline.run,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def minhash_sql(table: str = "documents") -> str:
    """Shingles joined with themselves, then reachability; the same rows by the plain definition."""
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') l from {table}),
s as (select distinct doc_id, unnest(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], ' ')) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
nb as (select a, b from e union select b, a from e),
r as (select doc_id a, doc_id b from {table} union select r.a, nb.b from r join nb on nb.a = r.b),
c as (select a doc_id, min(b) component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, c.component_id = d.doc_id kept from {table} d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id"""


def mixing_sql(table: str = "documents") -> str:
    return f"""with z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5('mix:' || doc_id) k from {table}),
s as (select source, sum(size)::bigint source_size from z group by source),
w as (select *, (list_value(5, 2, 1)[((row_number() over (order by source is null, source)) - 1) % 3 + 1])::double weight, (2 * source_size)::double cap, (sum(source_size) over ())::double * 1.5 as share from s),
l as (select *, (share - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as lev from w window o as (order by cap / weight, source is null, source)),
t as (select source, source_size, case when x is null then cap else least(cap, weight * x) end target from (select *, max(case when cap > weight * lev then lev end) over () x from l)),
g as (select z.*, source_size, target, floor(target + 0.5)::bigint budget, sum(size) over (partition by z.source order by k, doc_id rows unbounded preceding)::bigint upto from z join t on z.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as ep from g)
select doc_id, size, source_size, target, (ep * size + greatest(0, least(size, budget - ep * source_size - (upto - size))))::bigint taken from e"""


def topk_sql(table: str = "embeddings") -> str:
    return f"""with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from {table} where embedding is not null and vec_id is not null),
p as (select a.vec_id query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p)
select * from r where rank <= 5"""


def spans_sql(table: str = "documents") -> str:
    """Every string of 50 bytes with the smallest doc_id that it starts in; bytes are pairs of hex digits, cut in two steps."""
    size, step = spandedup.DEPTH, 1024
    return f"""with d as (select doc_id, hex(encode(coalesce(text, ''))) h from {table}),
c as (select doc_id, o, strlen(h) // 2 n, substr(h, 2 * o + 1, {2 * (step + size)}) s from (select *, unnest(range(0, strlen(h) // 2, {step})) o from d)),
w as (select doc_id, o + i p, substr(s, 2 * i + 1, {2 * size}) x from (select *, unnest(range(0, least({step}, n - {size - 1} - o))) i from c)),
f as (select x, min(doc_id) first from w group by x),
g as (select doc_id, p from w join f using (x) where first < doc_id),
r as (select *, sum(case when p <= before + {size} then 0 else 1 end) over (partition by doc_id order by p) k from (select *, lag(p) over (partition by doc_id order by p) before from g)),
s as (select doc_id, min(p) a, max(p) + {size} b from r group by doc_id, k),
t as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) kept_from from s),
k as (select doc_id, sum(b - a) n_removed, count(*) n_spans, max(b) rest, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) kept from t join d using (doc_id) group by doc_id)
select d.doc_id, cast(strlen(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * rest + 1), h))) kept_sha256 from d left join k on k.doc_id = d.doc_id"""


def lines_sql(table: str = "documents") -> str:
    """Every form against all earlier forms of like length that hold a third of it unchanged, as two edits leave one."""
    whole = "contains(a.form, left(b.form, length(b.form) // 3)) or contains(a.form, substr(b.form, length(b.form) // 3 + 1, length(b.form) // 3)) or contains(a.form, substr(b.form, length(b.form) // 3 * 2 + 1))"
    return f"""with l as (select doc_id, unnest(range(len(x))) line, unnest(x) raw from (select doc_id, string_split(text, chr(10)) x from {table} where text is not null)),
f as (select doc_id, line, doc_id * 1000000000 + line place, translate(trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') form from l),
g as (select form, strlen(form) n, min(place) first from f where form <> '' group by form),
e as (select a.form, min(b.first) near from g a join g b on b.n between a.n - {lines.BOUND} and a.n + {lines.BOUND} and b.first < a.first
  where case when {whole} then levenshtein(a.form, b.form) <= {lines.BOUND} else false end group by a.form),
v as (select f.doc_id, f.line, f.place > least(g.first, coalesce(e.near, g.first)) gone from f join g using (form) left join e using (form)),
k as (select l.doc_id, count(*) filter (gone) n_removed, string_agg(l.line::varchar, ',' order by l.line) filter (gone) removed, string_agg(raw, chr(10) order by l.line) filter (not coalesce(gone, false)) kept
  from l left join v on v.doc_id = l.doc_id and v.line = l.line group by l.doc_id)
select d.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end n_lines, coalesce(n_removed, 0) n_removed, coalesce(removed, '') removed, sha256(coalesce(kept, '')) kept_sha256
from {table} d left join k on k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": minhash_sql(), "op6_suffix_dedup": spans_sql(), "op7_exact_top_k": topk_sql(), "op9_source_mixing": mixing_sql(), "op10_line_dedup": lines_sql()}
