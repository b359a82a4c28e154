"""Named queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from quire.llm.common import table


def op1_line_dedup(spark, sf_dir):
    from quire.llm.line_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op2_sharding(spark, sf_dir):
    from quire.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op3_ngram_join(spark, sf_dir):
    from quire.llm.ngram_join import components

    return components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    from quire.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_neighbours(spark, sf_dir):
    from quire.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark, sf_dir):
    from quire.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_packing(spark, sf_dir):
    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark, sf_dir):
    from quire.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    from quire.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    from quire.llm.quality import op9_rows

    return op9_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_ngram_join, op4_license_scan, op5_neighbours, op6_mixing, op7_fingerprints, op8_html_text, op9_quality, op10_packing)}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), counted AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), placed AS (
  SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM counted WHERE w > 0
), windows AS (
  SELECT doc_id, pos AS first, max(pos) OVER f AS last, list(line) OVER f AS run, sum(w) OVER f AS words FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 31 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, pos, list(line) OVER b, sum(w) OVER b FROM placed
  WINDOW b AS (PARTITION BY doc_id ORDER BY s + w RANGE BETWEEN 31 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, first, last, rank() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM windows WHERE words >= 32
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM ranked WHERE nth > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
""",
    "op3_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n, coalesce(md5(string_agg(s.s, chr(10) ORDER BY s.s)), 'none ' || d.doc_id) AS same FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id
)
SELECT z.doc_id, z.n AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = z.doc_id) AS component_id, min(z.doc_id) OVER (PARTITION BY z.same) AS class_id FROM sizes z
""",
}
