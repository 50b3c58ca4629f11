"""Encodings of bytes, told from byte-order marks, UTF-8's own rules and the bytes that single-byte tables use.

All of it is column expressions over the bytes, read as Latin-1 so that each byte is one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte-order marks, the longer before the shorter.
MARKS = [("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8-SIG"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]
#: Bytes that windows-1252 leaves undefined.
UNDEFINED = "\x81\x8d\x8f\x90\x9d"


def encoding(content: Column) -> Column:
    """The name of the encoding of binary content; `BINARY` if no text encoding fits, `EMPTY` without bytes, null for null.

    Marks decide first. Then bytes below 128 without nulls are ASCII, and what follows UTF-8's rules is UTF-8 (a
    character cut at the end is forgiven). Nulls at nearly all even or odd places are UTF-16 without a mark; other
    nulls or many control bytes are binary. What is left is a single-byte table: Cyrillic if most high bytes are
    letters there (KOI8-R has small letters at C0-DF, windows-1251 at E0-FF), windows-1252 if bytes 80-9F occur that
    it defines, ISO-8859-1 if none of them do.
    """
    one = F.decode(content, "ISO-8859-1")
    n = F.length(one)
    count = lambda p: F.regexp_count(one, F.lit(p))
    start = F.hex(F.substring(content, 1, 4))
    cut = lambda k: F.decode(F.substring(content, F.lit(1), n - k), "ISO-8859-1")
    utf8 = F.lit(False)
    for k in range(4):
        # at most three bytes of a last character may be missing
        whole = F.encode(cut(k), "ISO-8859-1") if k else content
        tail_ok = F.lit(True) if not k else F.substring(content, n - k + 1, F.lit(1)) >= F.lit(b"\xc2")
        utf8 = utf8 | (tail_ok & (n > k) & F.is_valid_utf8(whole.cast("string")))
    # pairs of a byte and a null, from the start on
    even, odd = count("(?s)\\G[^\\x00]\\x00"), count("(?s)\\G\\x00[^\\x00]")
    high, nulls = count("[\\x80-\\xff]"), count("\\x00")
    controls = count("[\\x00-\\x08\\x0e-\\x1a\\x1c-\\x1f\\x7f]")
    koi, cp1251 = count("[\\xc0-\\xdf]"), count("[\\xe0-\\xff]")
    name = F.when(n == 0, "EMPTY")
    for mark, label in MARKS:
        name = name.when(start.startswith(mark), label)
    name = name.when((high == 0) & (nulls == 0) & (controls * 20 <= n), "ASCII")
    name = name.when((nulls == 0) & utf8, "UTF-8")
    name = name.when((even * 2 >= n * 0.7) & (n >= 4), "UTF-16LE").when((odd * 2 >= n * 0.7) & (n >= 4), "UTF-16BE")
    name = name.when((nulls > 0) | (controls * 20 > n), "BINARY")
    letters = count("[A-Za-z]")
    cyrillic = (high > letters) & (koi + cp1251 >= high * 0.8)
    name = name.when(cyrillic & (koi > cp1251), "KOI8-R").when(cyrillic, "WINDOWS-1251")
    name = name.when((count("[\\x80-\\x9f]") > 0) & (count(f"[{UNDEFINED}]") == 0), "WINDOWS-1252").when(count("[\\x80-\\x9f]") == 0, "ISO-8859-1")
    return F.when(content.isNotNull(), name.otherwise("BINARY"))


def mixed(files: DataFrame, exts: list[str], least: int = 10) -> DataFrame:
    """(root, dir, encodings): folders whose texts (of over `least` bytes) are in UTF-8 and in some other encoding but ASCII; files has root, dir, ext, size and encoding."""
    by_dir = files.where(F.col("ext").isin(exts) & (F.col("size") > least)).groupBy("root", "dir").agg(F.array_sort(F.collect_set("encoding")).alias("encodings"))  # a set of names from a short list
    return by_dir.where(F.array_contains("encodings", "UTF-8") & F.exists("encodings", lambda x: ~x.isin("UTF-8", "ASCII", "EMPTY")))
