"""Citation contexts found page by page: every anchor with its snippet, sentences, heading, cues and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.functions.normalize import squish
from citeloom.operators import rules as R

BIBLIO_PAGE = 4  # page score from which on a page counts as a bibliography


def page_hits(pages: DataFrame, anchors: str, cues: R.SeedCues, document: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """A row for each anchor of each page that is worth keeping, one for each different snippet of a document.

    References that show no seed are dropped; of equal snippets of a document the first by page and place stays.
    Pages without an anchor leave before anything else is looked at.
    """
    t = F.col(text)
    some = pages.where(t.rlike(f"(?i){anchors}")).withColumn("biblio_score", R.page_bibliography_score(t))
    hits = some.select(document, page, text, "biblio_score", F.explode(X.match_spans(t, f"(?i){anchors}")).alias("_m"))
    hits = hits.withColumns({"start": F.col("_m.start") + 1, "end": F.col("_m.end"), "match": F.col("_m.text")}).drop("_m")
    hits = X.with_char_window(hits, text, "start", "end", "snippet").withColumn("section_heading", X.section_heading(t, F.col("start")))
    hits = X.page_sentence_windows(hits, text, "start", "end").drop(text)
    hits = hits.withColumn("bib_like", R.looks_like_bibliography(F.col("snippet")))
    hits = R.classify_context(hits, "snippet", cues, (F.col("biblio_score") >= BIBLIO_PAGE) | F.col("bib_like"))
    hits = hits.where(~((F.col("citation_section") == "BIBLIO") & (F.col("semantic_label") == "LOW_CONFIDENCE")))
    hits = hits.withColumn("snippet_hash", F.xxhash64(squish(F.lower("snippet"))))
    first = Window.partitionBy(document, "snippet_hash").orderBy(page, "start")
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
