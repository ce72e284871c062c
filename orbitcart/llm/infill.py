"""Fill-in-middle texts (operator 13): prefix, suffix and middle around two cuts between tokens.

Tokens are runs of letters A-Z, a-z and single other characters. The characters of a block of
texts become class codes of a wavelet matrix (first letter of a run, further letter, white
space, other); the ranks of the three classes that begin a token add up to the number of
tokens before any position, and bisection on these ranks finds where the wanted number of
tokens ends, for both cuts of all texts of the block at once. Only the two cut positions come
back from Python; Spark cuts the texts and joins the parts.

Cuts and form follow from sha256 of ``seed:id``, so a result depends on the row alone. Texts that
hold a sentinel stay plain, so the exact text can be rebuilt (``restore``).

Defined cases: null and empty texts are plain with 0 tokens; a null id hashes as an empty one;
repeated rows get equal results; an empty table gives no rows; other columns are not read. Very
long texts are processed whole: a block holds whole texts, at least one, and needs about 30 bytes
a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbitcart.llm.common import only, text_or_empty
from orbitcart.llm.wavelet import WaveletMatrix

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Percent of texts that stay plain, percent of the others in suffix-prefix-middle form.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of the texts that one wavelet matrix covers (a longer text has its own).
BLOCK_CHARS = 1 << 20
# Class codes.
WITHIN, FIRST, SPACE, OTHER = range(4)
SPACES = " \t\n\x0b\x0c\r"


def class_codes(text: str, begins: np.ndarray) -> np.ndarray:
    """A class code for each character of ``text``; a new text begins at each position of ``begins``."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = points | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    after_letter = np.zeros(len(points), bool)
    after_letter[1:] = letter[:-1]
    after_letter[begins[begins < len(points)]] = False
    return np.select([letter & after_letter, letter, np.isin(points, [ord(c) for c in SPACES])],
                     [WITHIN, FIRST, SPACE], OTHER).astype(np.uint8)


def tokens_before(matrix: WaveletMatrix, at: np.ndarray) -> np.ndarray:
    return matrix.rank(FIRST, at) + matrix.rank(SPACE, at) + matrix.rank(OTHER, at)


def cut_positions(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The last position from ``low`` to ``high`` with at most ``tokens`` tokens begun since ``low``."""
    goal = tokens_before(matrix, low) + tokens
    low, high = low.copy(), high.copy()
    while (low < high).any():
        half = (low + high + 1) >> 1
        fits = tokens_before(matrix, half) <= goal
        low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
    return low


def _block(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    matrix = WaveletMatrix(class_codes("".join(texts), begins))
    n = tokens_before(matrix, ends) - tokens_before(matrix, begins)
    units = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    return n, cut_positions(matrix, begins, ends, units[0]) - begins, cut_positions(matrix, begins, ends, units[1]) - begins


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    a, b = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    done, texts, chars, at = [], [], 0, 0

    def close() -> None:
        nonlocal texts, chars, at
        done.append(_block(texts, a[at:at + len(texts)], b[at:at + len(texts)]))
        at, texts, chars = at + len(texts), [], 0

    for value in text:
        value = value.as_py()
        if texts and chars + len(value) > BLOCK_CHARS:
            close()
        texts.append(value)
        chars += len(value)
    if texts:
        close()
    parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*done) if done else ([], [], []))]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in parts], ["n", "first", "second"])


CUTS = StructType([StructField(name, LongType()) for name in ("n", "first", "second")])
_cuts_udf = F.arrow_udf(_cuts, CUTS)


def draws(seed: int, id_col: str) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:id`` as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _part(text: Column, start: Column, length: Column) -> Column:
    return F.substr(text, (start + 1).cast("int"), length.cast("int"))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, text, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    h1, h2, h3, h4 = draws(seed, "doc_id")
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(sentinel))
    form = (F.when((F.col("text") == "") | held | (h3 % 100 >= 100 - plain_percent), "plain")
             .when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumns({"form": form, "cuts": _cuts_udf("text", h1, h2)})
    text, first, second = F.col("text"), F.col("cuts.first"), F.col("cuts.second")
    prefix, middle = _part(text, F.lit(0), first), _part(text, first, second - first)
    suffix = F.substr(text, (second + 1).cast("int"))
    output = (F.when(F.col("form") == "plain", text)
               .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
               .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    shaped = F.col("form") != "plain"
    return rows.select("doc_id", "text", F.col("cuts.n").alias("n"), "form", F.when(shaped, first).alias("prefix_chars"),
                       F.when(shaped, second - first).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts lie around the sentinels, each found once."""
    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.instr(output, F.lit(second))
        end = F.instr(output, F.lit(MIDDLE))
        return (F.substr(output, F.lit(len(first) + 1), at - 1 - len(first)),
                F.substr(output, at + len(second), end - at - len(second)), F.substr(output, end + len(MIDDLE)))

    prefix, suffix, middle = split(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
