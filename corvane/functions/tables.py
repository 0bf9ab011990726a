"""Row-making functions callable from SQL: chunks and passages of a text, by LATERAL join.

    SELECT d.doc_id, c.chunk_index, c.text FROM documents d, LATERAL chunk_text(d.text, 800, 120) c
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunk


@udtf(returnType="chunk_index int, text string")
class ChunkText:
    """The chunks of a text, over its normalized form; none of a null or empty one."""

    def eval(self, text: str, size: int = 800, overlap: int = 120):
        if problem := chunk.check(size, overlap):
            raise ValueError(problem)
        yield from enumerate(chunk.pieces(chunk.normalized(text), size, overlap))


@udtf(returnType="passage_index int, start int, end int, text string")
class WebPassages:
    """The passages of a page's text, with where they start and end in it."""

    def eval(self, text: str, size: int = 1200, overlap: int = 160):
        for i, found in enumerate(chunk.passages(text or "", size, overlap)):
            yield (i, *found)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("web_passages", WebPassages)
