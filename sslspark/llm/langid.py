"""Language identification by compression.

For each language a zstandard raw-content dictionary is put together from
labelled texts.  A text is encoded with every dictionary, in segments so that
the dictionary counts along the whole text (letter case is folded), and the language whose dictionary
gives the fewest bytes is chosen; where the runner-up comes close the decision
is rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected; equal sizes go to the language that sorts first and are rejected;
repeated rows get equal answers; without any labelled row every text is
``und``; an empty table gives no rows; language and source columns are not read
in prediction.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

UNKNOWN = "und"


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = 400, dictionary_bytes: int = 64_000) -> dict[str, bytes]:
    """One dictionary for each language, from a bounded sample: about
    ``rows_per_language`` labelled rows with the smallest id hashes, of these
    the distinct sentences in hash order up to ``dictionary_bytes``; longer
    sentences in pieces of 1,000 characters.  Warns of languages that get none.

    One pass counts the rows of each language and gives a hash bound; only the
    texts below it are read, and only the dictionaries reach the driver."""
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    h = F.xxhash64(F.lit("langid"), id_col)
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).agg(F.count("*")).collect()}  # one row a language
    bound = F.lit(None).cast("long")
    for lang, n in counts.items():
        bound = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, rows_per_language / n) * (2 ** 64 - 2 ** 12)) - 2 ** 63)).otherwise(bound)
    sentences = (usable.where(h <= bound)
                 .select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), r"(?<=[.!?])\s+|\n")).alias("s"))
                 .where(F.length("s") > 0)
                 .select("lang", F.explode(F.expr("transform(sequence(1, length(s), 1000), i -> substring(s, i, 1000))")).alias("s")).distinct())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("s"), "s")
    rows = (sentences.withColumn("size", F.sum(F.octet_length("s") + 1).over(order))
            .where(F.col("size") <= dictionary_bytes).select("lang", "size", "s").collect())
    books: dict[str, list[bytes]] = {}
    for r in sorted(rows):
        books.setdefault(r["lang"], []).append(r["s"].encode())
    out = {lang: book for lang, parts in sorted(books.items()) if len(book := b"\n".join(parts)) >= 8}
    if missing := sorted(set(counts) - set(out)):
        warnings.warn(f"no dictionary for labelled languages {missing}", stacklevel=2)
    return out


def sizes_of(text: bytes, coders: list, segment: int = 2_000) -> list[int]:
    """Bytes of a text under every dictionary; segments end where characters end."""
    total = [0] * len(coders)
    at = 0
    while at < len(text):
        end = min(len(text), at + segment)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        part = text[at:end]
        total = [n + len(c(part)) for n, c in zip(total, coders, strict=True)]
        at = end
    return total


def predict(docs: DataFrame, books: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            margin: float = 0.01, level: int = 6, sharpness: float = 40.0) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, rejected`` appended (columns of
    these names are replaced).  The
    margin is how much larger the runner-up is than the winner, as a share; a
    decision below ``margin`` is rejected.  The score is the winner's weight
    when a size ``x`` times the smallest weighs exp(-sharpness * (x - 1))."""
    langs = list(books)
    found = ["lang_pred", "score", "margin", "rejected"]
    rest = [c for c in docs.columns if c not in found]
    kinds = {f.name: to_arrow_type(f.dataType) for f in docs.schema if f.name in rest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard
        letter = regex.compile(r"\p{L}")
        coders = []
        for lang in langs:
            book = zstandard.ZstdCompressionDict(books[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False, write_dict_id=False).compress)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], []]
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    if not text or not coders or not letter.search(text):
                        row = (UNKNOWN, 0.0, 0.0, True)
                    else:
                        n = sizes_of(text.lower().encode(), coders)
                        order = sorted(range(len(n)), key=lambda k: (n[k], k))
                        best = n[order[0]]
                        gap = n[order[1]] / best - 1 if len(n) > 1 else 1.0
                        row = (langs[order[0]], 1 / sum(math.exp(-sharpness * (x / best - 1)) for x in n), gap, gap < margin)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)).cast(kinds[c]) for c in rest]
                    + [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())],
                    names=rest + found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    return docs.select(*rest).mapInArrow(run, schema + ", lang_pred string, score double, margin double, rejected boolean")
