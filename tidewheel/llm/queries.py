"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontam, htmltext, lines, neardup, pieces, pii, quality, secrets, tokenstore, warc
from tidewheel.llm.oracles import ORACLE  # noqa: F401
from tidewheel.llm.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    "op1_pii": lambda s, d: pii.digest(pii.find(table(s, d, "documents"))),
    "op2_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op3_ngram_join": lambda s, d: neardup.components(table(s, d, "documents"), 3, 90),
    "op4_secrets": lambda s, d: secrets.scan_documents(table(s, d, "documents")),
    "op5_html_text": lambda s, d: htmltext.extract(table(s, d, "pages")),
    "op6_decontamination": lambda s, d: decontam.decontaminate(table(s, d, "documents"), table(s, d, "benchmark")).drop("text_hash"),
    "op7_token_files": lambda s, d: tokenstore.round_trip(table(s, d, "documents"), tokenizer_file("byte_bpe_50k.json")),
    "op8_pieces": lambda s, d: pieces.encode(table(s, d, "documents"), tokenizer_file("piece_bpe_32k.model")),
    "op9_line_dedup": lambda s, d: lines.digest(lines.deduplicate(table(s, d, "documents"))),
    "op10_quality": lambda s, d: quality.digest(quality.judge(table(s, d, "documents"))),
}
