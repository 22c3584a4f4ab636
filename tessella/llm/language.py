"""Language identification by compression with one dictionary of raw content per language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, ship, spare, table, texts

#: The bound of the sample that dictionaries are made of: documents of each language, and bytes of each document and dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 96, 4_096, 65_536
#: Texts of fewer bytes are in the sample of a language only where longer ones leave room.
SHORT = 200
#: Bytes compressed at a time, so that the dictionary rather than the text before decides.
BLOCK = 4_096
#: The runner-up must be larger by more than this share of the winner's size, less one byte, as sizes are whole bytes.
MARGIN = 0.005

_NO_LETTER = re.compile(r"[\W\d_]+")


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)


def _letters(text: str) -> bytes:
    """The whole text's words in lower case, anything else as one space."""
    return _NO_LETTER.sub(" ", text.lower()).encode()


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary of raw content for each language, from docs (doc_id, text, lang) whose lang is not null.

    The sample is bounded by documents and bytes, whatever the table's size: the documents with the smallest hashes of
    doc_id, those under SHORT bytes after all others. The driver gets at most SAMPLE_DOCS * SAMPLE_BYTES per language.
    Every language with a text that has letters gets a dictionary. Languages come by how many documents they have, the
    most common first.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("at"))
    begin = F.substring("text", 1, SAMPLE_BYTES)
    known = known.where(begin.rlike(r"\p{L}")).select("lang", "at", (F.octet_length("text") < SHORT).alias("short"), begin.alias("text"))
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("short", "at", "text"))).where(f"n <= {SAMPLE_DOCS}")
    rows = ranked.orderBy("lang", F.desc("short"), "n").collect()  # a dictionary too large loses its beginning
    found: dict[str, list[bytes]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append(_letters(row["text"]))
    counts = {r["lang"]: r["count"] for r in docs.where("lang IS NOT NULL").groupBy("lang").count().collect()}
    return {lang: b" ".join(found[lang])[-DICTIONARY_BYTES:] for lang in sorted(found, key=lambda x: (-counts[x], x))}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with lang_pred, score and rejected, or as `names` says, for every row (text is needed; columns of these names are replaced).

    Every whole text's words are compressed in blocks with each language's dictionary; the smallest total wins, ties
    go to the more common language. score is the share of the winner in the likelihoods that the sizes stand for.
    rejected: no language, or the runner-up is larger by no more than `margin` of the winner's size less a byte; so the
    margin grows with the text, and a size under 200 bytes is never too close.

    Null text, or text without letters: `und`, score 0, rejected. So is everything if no language was learned.
    """
    ship(docs.sparkSession)
    langs = list(dictionaries)
    extra = list(zip(names, (pa.string(), pa.float64(), pa.bool_())))
    kept = [c for c in docs.columns if c not in {n for n, _ in extra}]
    (mark,) = spare(docs, "_lettered")
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        made = [zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in langs]
        for d in made:
            d.precompute_compress(compression_params=_parameters())
        tools = [zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters()) for d in made]
        for batch in batches:
            preds, scores, rejected = [], [], []
            texts_, letters = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index(mark))
            for i in range(batch.num_rows):
                if not langs or not letters[i].as_py():
                    preds.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                raw = _letters(texts_[i].as_py())
                sizes = np.array([sum(len(tool.compress(raw[at : at + BLOCK])) for at in range(0, len(raw), BLOCK)) for tool in tools], float)
                order = np.argsort(sizes, kind="stable")
                best = sizes[order[0]]
                preds.append(langs[order[0]])
                scores.append(float(1 / np.exp2(-8 * np.minimum(sizes - best, 100)).sum()))
                rejected.append(len(order) > 1 and sizes[order[1]] - best + 1 <= margin * best)
            own = [n for n in batch.schema.names if n != mark]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in own), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*own, *(n for n, _ in extra)])

    frame = docs.select(*(F.col(f"`{c}`") for c in kept), lettered.alias(mark))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema)
    return frame.mapInArrow(lean(run), f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The docs that are not rejected, all columns as they are whatever their names, a null lang as predicted; learned
    from their own lang. Rows with null texts or texts without letters go; repeated rows and null doc_ids are rows like
    others. No row with lang: nothing can be learned and every row goes. Empty table: no rows."""
    names = spare(docs, "lang_pred", "score", "rejected")
    found = classify(docs, fit(docs), names=tuple(names)).where(~F.col(f"`{names[2]}`"))
    lang = F.coalesce(F.col("lang"), F.col(names[0])).alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def fold() -> F.Column:
    """Whether a document is held out: crc32 of its doc_id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = classify(texts(docs), fit(docs.where(~fold())))
    return found.select("doc_id", fold().alias("held_out"), "lang_pred", "score", "rejected")
