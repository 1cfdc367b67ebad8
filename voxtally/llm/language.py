"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound_batches, map_arrow

NOT_LETTERS = regex.compile(r"[^\p{L}]+")
BLOCK = 2048          # bytes of a text that are encoded at once
LEVEL = 6
# Goes before every block: very short blocks would otherwise be stored as they are.
FILLER = b"0" * 64
# Share of bytes that the best language must save against the second best. Of 2,499
# held-out texts in learned languages 10 save less, 7 of them misjudged; of 2,454
# texts of 64 bytes or more whose language was not learned 2,245 do.
MARGIN = 0.025


def letters_only(text: str) -> str:
    """Lower-cased words of letters between single spaces; blank without a letter."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def learn_dictionaries(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       lang: str = "lang", per_language: int = 200, piece: int = 600,
                       most_languages: int = 200) -> dict[str, bytes]:
    """Raw dictionary content of every language of a labelled table.

    The model is fitted on a bounded sample: about ``per_language`` rows of
    each language, those with the smallest hash of id and text, and ``piece``
    characters from the beginning of each. Rows without text or language teach
    nothing. More than ``most_languages`` languages are an error.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.substring(F.col(text), 1, piece).alias("piece"),
        (F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string"), F.col(text)) / 2.0 ** 64 + 0.5).alias("u"))
    counts = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], 1.5 * per_language / r["count"]).otherwise(share)
    drawn: dict[str, list] = {r["lang"]: [] for r in counts}
    # copies share a hash, so their number is bounded too
    for r in rows.filter(F.col("u") <= share).limit(4 * per_language * len(counts)).collect():
        drawn[r["lang"]].append((r["u"], r["piece"]))
    # the least hash goes last: the end of a dictionary is the cheapest to refer to
    return {k: "".join(letters_only(t) for _, t in sorted(v)[:per_language][::-1]).encode()
            for k, v in sorted(drawn.items()) if v}


def sizes_of(data: bytes, coders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of a whole text, block by block, under each dictionary."""
    total = np.zeros(len(coders), dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        block = FILLER + data[at:at + BLOCK]
        total += [len(c.compress(block)) for c in coders]
    return total


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                      min_margin: float = MARGIN, min_bytes: int = 64, prefix: str = "") -> DataFrame:
    """Add ``lang_pred, score, rejected`` (with ``prefix``) to each row; whole texts are read.

    Texts are reduced to lower-cased words of letters and encoded block by block;
    the language whose dictionary gives the fewest bytes is predicted; of equal
    ones the first by name. ``score`` is 1 minus the ratio of those bytes to the
    second fewest, scaled so that a tenth saved is 1; with one language it is 1.
    A text that is NULL or has no letter is ``und`` with score 0, as is every
    text when no language was learned. ``rejected``: undetermined, or the saving
    is below ``min_margin``, one byte in 40, in a text of ``min_bytes`` or more;
    a shorter one keeps its best guess, also at a tie: with ``min_bytes`` 0 every
    text has to show the margin. All columns of ``docs`` are kept; the new ones
    replace columns of the same name.
    """
    bound_batches(docs.sparkSession)
    names = sorted(dictionaries)
    added = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    keep = [c for c in docs.columns if c not in added]
    schema = docs.select(*keep).schema.add(added[0], "string").add(added[1], "double").add(added[2], "boolean")
    at = keep.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for name in names:
            model = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            model.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=model, write_content_size=False))
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(at):
                words = letters_only(value.as_py() or "")
                if not coders or words.isspace():
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                data = words.encode()
                size = sizes_of(data, coders)
                best = int(size.argmin())
                second = np.delete(size, best).min() if len(size) > 1 else None
                saved = 1.0 if second is None else 1.0 - size[best] / second
                langs.append(names[best])
                scores.append(min(1.0, 10 * saved))
                rejected.append(saved < min_margin and len(data) >= min_bytes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*keep, *added])

    return map_arrow(docs.select(*keep), judge, schema)


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text modulo ``folds``; NULL hashes as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
