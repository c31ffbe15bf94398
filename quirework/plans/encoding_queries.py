"""Queries of the encodings of text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import encodings
from quirework.plans.adapter import books, cte
from quirework.plans.built_files import built
from quirework.plans.registry import query

#: The documents' accented letters as Czech and Polish ones, six of which stand at other places in the two encodings of these.
_CZECH = "translate(text, 'äöüßéèóñíçêÄÖÜÉÈÓÑÍÇÊ', 'čřůšéěóžíťęČŘŮÉĚÓŽÍŤĘ')"
_KINDS = ("utf-8", "cp1250", "iso-8859-2")


@query(cte() + f""", t AS (SELECT id, {_CZECH} AS t FROM books), f AS (SELECT *, regexp_matches(t, '[^\\x00-\\x7F]') AS high, regexp_matches(t, '[šťžŠŤŽ]') AS apart FROM t WHERE t <> '')
SELECT id, CASE WHEN NOT high THEN 'ascii' WHEN id % 3 = 0 THEN 'utf-8' WHEN id % 3 = 2 AND apart THEN 'iso-8859-2' ELSE 'cp1250' END AS encoding FROM f""")
def encoding_detected(spark, sf_dir):
    """Documents written in one of three encodings, four in five of them trained on; those whose bytes are the same in two encodings count as the preferred one."""
    b = books(spark, sf_dir).selectExpr("id", f"{_CZECH} AS text").where("text <> ''")
    model = encodings.train(b.where("id % 5 > 0"))
    content = built(lambda t, k: t.encode(_KINDS[k], "replace"))(F.col("text"), (F.col("id") % 3).cast("int"))
    return encodings.detected(b.select("id", content.alias("content")), model)
