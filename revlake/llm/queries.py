"""The training-data operators as queries over the driver's tables, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0), kept_sha256 of the text that stays."""
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"), F.sha2("deduped_text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sp_encode import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report_pii

    return report_pii(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_lm_scoring, op3_quality, op4_line_dedup, op5_packing, op6_jaccard_join, op7_embedding_dedup, op8_sentencepiece, op9_pii, op10_html_extract)}


#: Lines of 8 words or more are near within one word edit; of equal and near lines the earliest stays.
LINE_DEDUP_SQL = """
with line as (
  select doc_id, unnest(range(0, len(s))) as pos, unnest(s) as line
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)),
first as (select line, min(doc_id * 1048576 + pos) as place from line where trim(line) <> '' group by line),
long as (select line, place, string_split(line, ' ') as w, len(string_split(line, ' ')) as n from first where len(string_split(line, ' ')) >= 8),
cut as (
  select line, place, n, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ')) as k
  from (select *, unnest(range(1, n + 1)) as i from long)),
swap as (select n, i, k, min(place) as least from cut group by n, i, k having count(*) > 1),
grown as (
  select a.line as short_line, a.place as short_place, b.line as long_line, b.place as long_place
  from (select line, place, n, md5(line) as k from long) a join cut b on a.k = b.k and b.n = a.n + 1),
near as (
  select line from cut join swap using (n, i, k) where place > least
  union select long_line from grown where short_place < long_place
  union select short_line from grown where long_place < short_place),
marked as (
  select l.doc_id, l.pos, l.line,
    trim(l.line) <> '' and (l.doc_id * 1048576 + l.pos <> f.place or l.line in (select line from near)) as gone
  from line l left join first f on l.line = f.line)
select d.doc_id, count(m.pos) as n_lines, count(*) filter (where m.gone) as n_dropped,
  coalesce(string_agg(cast(m.pos as varchar), ',' order by m.pos) filter (where m.gone), '') as dropped,
  sha256(coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where not coalesce(m.gone, false)), '')) as kept_sha256
from documents d left join marked m on d.doc_id = m.doc_id
group by d.doc_id
"""

_WORDS = "[x for x in string_split_regex(lower_ascii, '[\\x20\\x09-\\x0D]+') if x <> '']"

#: Shingle sets as lists, links by shared shingles, components by a recursive walk.
JACCARD_SQL = f"""
with recursive doc as (
  select doc_id, {_WORDS} as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
shingle as (
  select distinct doc_id, md5(array_to_string(case when len(w) < 5 then w else w[i:i + 4] end, ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair p join size x on p.a = x.doc_id join size y on p.b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
walk as (select doc_id as start, doc_id as node from documents union select walk.start, link.b from walk join link on walk.node = link.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
from documents d left join size s on d.doc_id = s.doc_id join (select start, min(node) as component_id from walk group by start) c on d.doc_id = c.start
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP_SQL, "op6_jaccard_join": JACCARD_SQL}
