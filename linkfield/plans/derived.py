"""Page tables that the registered queries work on, derived from the whole pages table.

Every page row is a document: its words laid out on body pages, and page 99 with lines around its url, OCR words, QR
hits at four pyramid levels, and annotations.  SQL that both Spark and DuckDB read is kept as text; {words} and
{points} stand for what they spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BODY = """
SELECT page_id AS doc_id, CAST(floor(i / 360) AS INT) + 1 AS page_number, 0 AS source_rank, 0 AS tile_y, CAST(i AS INT) AS seq, word AS text,
       CAST(72 + (i % 8) * 60 AS DOUBLE) AS left_pt, CAST(720 - (CAST(floor(i / 8) AS INT) % 45) * 14 AS DOUBLE) AS bottom_pt,
       CAST(6 * least(length(word), 9) AS DOUBLE) AS width_pt, CAST(12 AS DOUBLE) AS height_pt, CAST(3 AS DOUBLE) AS space_width
FROM ({words}) w
"""

APPENDIX = """
SELECT page_id AS doc_id, 99 AS page_number, 0 AS source_rank, 0 AS tile_y, k AS seq,
       CASE k WHEN 0 THEN 'See (' || left(url, 12) WHEN 1 THEN substr(url, 13) || '), thanks.' WHEN 2 THEN 'Get the app:'
              WHEN 3 THEN substr(url, strpos_(url, '://') + 3) || '.' WHEN 4 THEN 'www.x' || CAST(page_id AS VARCHAR_) || '.com/p'
              WHEN 5 THEN 'Requires v1.2/beta, section 3.14/2' WHEN 6 THEN url || ' and ' || url || '/b'
              WHEN 7 THEN '   ' ELSE 'https://example.com/wiki/Foo_(d' || CAST(page_id % 7 AS VARCHAR_) || ').' END AS text,
       CAST(CASE k WHEN 1 THEN 172 WHEN 3 THEN 180 ELSE 72 END AS DOUBLE) AS left_pt,
       CAST(700 - 40 * CASE WHEN k < 2 THEN 0 WHEN k < 4 THEN 1 ELSE k - 2 END AS DOUBLE) AS bottom_pt,
       CAST(CASE k WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE 220 END AS DOUBLE) AS width_pt, CAST(12 AS DOUBLE) AS height_pt, CAST(3 AS DOUBLE) AS space_width
FROM pages CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) v(k)) n WHERE url IS NOT NULL
"""

PAGES_DIM = """
SELECT DISTINCT doc_id, page_number, CAST(612 AS DOUBLE) AS page_width_pt, CAST(792 AS DOUBLE) AS page_height_pt, 2550 AS bitmap_width, 3300 AS bitmap_height FROM text_chunks
"""

ANNOTATIONS = """
SELECT page_id AS doc_id, 99 AS page_number, CASE k WHEN 1 THEN 'Text' ELSE 'Link' END AS subtype, url AS uri,
       CAST(CASE k WHEN 0 THEN 72 + (page_id % 4) * 100 ELSE 72 END AS DOUBLE) AS left_pt, CAST(CASE k WHEN 0 THEN 700 WHEN 1 THEN 620 ELSE 460 END AS DOUBLE) AS bottom_pt,
       CAST(CASE k WHEN 0 THEN 300 WHEN 1 THEN 220 ELSE 0 END AS DOUBLE) AS width_pt, CAST(12 AS DOUBLE) AS height_pt
FROM pages CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) v(k)) n WHERE url IS NOT NULL
"""

OCR_WORDS = """
SELECT page_id AS doc_id, 99 AS page_number, CASE k WHEN 2 THEN 'tile' ELSE 'whole' END AS pass, CASE k WHEN 2 THEN 275 * CAST(page_id % 12 AS INT) ELSE 0 END AS tile_y, k AS seq,
       CASE WHEN k = 0 AND page_id % 4 = 0 THEN replace(url, 'e', 'c') WHEN k = 0 AND page_id % 4 = 2 THEN ' ' || url || ' ' WHEN k = 0 THEN 'noise' WHEN k = 1 THEN ' '
            ELSE 'https://tile.example.org/p' || CAST(page_id AS VARCHAR_) END AS text,
       300 AS px_left, CASE k WHEN 2 THEN 20 ELSE 325 END AS px_top, 1550 AS px_right, CASE k WHEN 2 THEN 70 ELSE 375 END AS px_bottom
FROM pages CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) v(k)) n WHERE url IS NOT NULL
"""

QR_DETECTIONS = """
SELECT page_id AS doc_id, 99 AS page_number, level_no, scale, inverted, c AS decode_no,
       CASE page_id % 5 WHEN 3 THEN 'www.h' || CAST(page_id AS VARCHAR_) || '.com/q' WHEN 4 THEN 'plain text ' || CAST(page_id AS VARCHAR_) ELSE url END AS payload,
       {points} AS points
FROM (SELECT *, CAST(c * 800 * (page_id % 3) AS DOUBLE) AS down FROM pages
  CROSS JOIN (SELECT level_no, CAST(s AS DOUBLE) AS scale FROM (VALUES (0, 1.0), (1, 0.6), (2, 0.4), (3, 0.25)) v(level_no, s)) l
  CROSS JOIN (SELECT * FROM (VALUES (false), (true)) v(inverted)) i CROSS JOIN (SELECT * FROM (VALUES (0), (1)) v(c)) d WHERE url IS NOT NULL) x
"""

# The same without the chunks: every document's body pages by its number of words, and its appendix.
SPARK_PAGES_DIM = r"""
SELECT doc_id, page_number, CAST(612 AS DOUBLE) AS page_width_pt, CAST(792 AS DOUBLE) AS page_height_pt, 2550 AS bitmap_width, 3300 AS bitmap_height FROM (
  SELECT page_id AS doc_id, url, coalesce(regexp_count(regexp_replace(html, '<[^>]*>', ' '), '[^ \\t\\r\\n]+'), 0) AS n FROM pages) q
LATERAL VIEW explode(array_distinct(concat(if(n > 0, sequence(1, CAST(ceil(n / 360) AS INT)), array()), if(url IS NOT NULL, array(99), array())))) e AS page_number
"""

SPARK_WORDS = r"SELECT page_id, i, word FROM pages LATERAL VIEW posexplode(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' '), '[^ \\t\\r\\n]+', 0)) e AS i, word"
SPARK_POINTS = "array(named_struct('x', 600 * scale, 'y', (500 + down) * scale), named_struct('x', 1000 * scale, 'y', (500 + down) * scale), named_struct('x', 600 * scale, 'y', (900 + down) * scale))"
DUCK_WORDS = r"SELECT page_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^ \t\r\n]+') AS ws FROM pages) q"
DUCK_POINTS = "[{'x': 600 * scale, 'y': (500 + down) * scale}, {'x': 1000 * scale, 'y': (500 + down) * scale}, {'x': 600 * scale, 'y': (900 + down) * scale}]"

PATHS = """
SELECT page_id AS doc_id, '/in/d.' || CAST(page_id % 10 AS VARCHAR_) || '/' || regexp_replace(url, '[^A-Za-z0-9.]', '_'{all}) ||
       CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.Jpeg' WHEN 4 THEN '.webp' WHEN 5 THEN '.gif' WHEN 6 THEN '.bmp' WHEN 7 THEN '.txt' ELSE '' END AS path,
       CAST(600 + page_id % 1000 AS INT) AS bitmap_width, CAST(800 + page_id % 700 AS INT) AS bitmap_height
FROM pages WHERE url IS NOT NULL
"""


def _sql(text: str, spark: bool) -> str:
    text = text.replace("{words}", SPARK_WORDS if spark else DUCK_WORDS).replace("{points}", SPARK_POINTS if spark else DUCK_POINTS).replace("{all}", "" if spark else ", 'g'")
    return text.replace("VARCHAR_", "STRING" if spark else "VARCHAR").replace("strpos_", "instr")


#: The derived tables as DuckDB SQL.
DUCK = {
    "text_chunks": f"{_sql(BODY, False)} UNION ALL {_sql(APPENDIX, False)}",
    "pages_dim": PAGES_DIM,
    "annotations": _sql(ANNOTATIONS, False),
    "ocr_words": _sql(OCR_WORDS, False),
    "qr_detections": _sql(QR_DETECTIONS, False),
    "paths": _sql(PATHS, False),
}


class Tables:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.pages = spark, spark.read.parquet(f"{sf_dir}/pages.parquet")

    def _of(self, text: str, **tables: DataFrame) -> DataFrame:
        tables.setdefault("pages", self.pages)
        text = _sql(text, True)
        for name, df in tables.items():
            df.createOrReplaceTempView(f"derived_{name}")
            text = re.sub(rf"\bFROM {name}\b", f"FROM derived_{name}", text)
        return self.spark.sql(text)

    @property
    def text_chunks(self) -> DataFrame:
        return self._of(BODY).unionByName(self._of(APPENDIX))

    @property
    def pages_dim(self) -> DataFrame:
        return self._of(SPARK_PAGES_DIM)

    @property
    def annotations(self) -> DataFrame:
        return self._of(ANNOTATIONS)

    @property
    def ocr_words(self) -> DataFrame:
        return self._of(OCR_WORDS)

    @property
    def qr_detections(self) -> DataFrame:
        return self._of(QR_DETECTIONS)

    @property
    def paths(self) -> DataFrame:
        return self._of(PATHS)
