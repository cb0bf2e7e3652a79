"""Fill-in-the-middle: a text is cut at two of its token borders, and its middle goes last.

Tokens are a word with the white space before it, or white space at the end of the text. Their ends are marked in a
packed bit vector over the UTF-8 bytes; a directory holds the ones before every 512 bits. The ones in a text are its
number of tokens n; two numbers of units, drawn from a hash of the document's id, select two ones, whose places are
the byte cuts. A second vector marks the bytes that begin a code point; its ranks turn cuts into numbers of characters.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle). Texts that
are empty or hold one of the marks are plain, so :func:`restored` is exact: a mark ends in ``>`` and begins with ``<``,
so none can arise across a cut.

Every text is worked on by itself, beside others of its batch: no shuffle, and a lost executor costs its tasks.
Nulls: a null text is empty, a null id is hashed as no digits. Rows that repeat, and equal ids, give equal results. Very long texts are
cut whole (about twenty bytes of memory for each of theirs). An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import table
from barsmith.llm.flat import flat, parts, raw

#: The marks, and the shares in per cent of rearranged texts and, of these, of suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM_RATE = 50, 80
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A packed bit vector that counts ones before a place, and finds the place of the k-th one."""

    def __init__(self, flags: np.ndarray):
        self.words = np.zeros((len(flags) // 512 + 1, 8), np.uint64)
        packed = np.packbits(flags, bitorder="little")
        self.words.view(np.uint8).reshape(-1)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word, bit = at >> 9, (at >> 6) & 7, (at & 63).astype(np.uint64)
        words = self.words[block]
        ones = np.bitwise_count(words).astype(np.int64)
        inside = np.where(np.arange(8) < word[:, None], ones, 0).sum(axis=1)
        last = words[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + inside + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, "right") - 1
        words = self.words[block]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(axis=1)
        every = np.arange(len(k))
        left -= np.where(word > 0, upto[every, word - 1], 0)
        bits = np.unpackbits(words[every, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = np.argmax(np.cumsum(bits, axis=1) == left[:, None] + 1, axis=1)
        return (block << 9) + (word << 6) + bit


def draws(id_: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digits = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(ids: list, texts: list[bytes], seed: int, rate: int, spm_rate: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    data, offsets = flat(texts)
    starts, ends = offsets[:-1], offsets[1:]
    space = SPACE[data]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    last = ends[ends > starts] - 1
    after[last] = True
    tokens = ~space & after
    tokens[last] = True
    tokens, chars = Bits(tokens), Bits((data & 0xC0) != 0x80)
    first = tokens.rank(starts)
    n = tokens.rank(ends) - first
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    units = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    cuts = np.repeat(starts[:, None], 2, axis=1)
    where = units > 0
    cuts[where] = tokens.select((first[:, None] + units)[where] - 1) + 1
    upto = np.stack([chars.rank(c) for c in (starts, cuts[:, 0], cuts[:, 1])])
    out = []
    for k, t in enumerate(texts):
        if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h[k, 2] % 100 >= rate:
            out.append((int(n[k]), "plain", None, None, t))
            continue
        a, b = (cuts[k] - starts[k]).tolist()
        spm = h[k, 3] % 100 < spm_rate
        output = b"".join((SUFFIX, t[b:], PREFIX, t[:a], MIDDLE, t[a:b]) if spm else (PREFIX, t[:a], SUFFIX, t[b:], MIDDLE, t[a:b]))
        out.append((int(n[k]), "spm" if spm else "psm", int(upto[1, k] - upto[0, k]), int(upto[2, k] - upto[1, k]), output))
    return out


def transformed(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each row of ``docs``.

    ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of these with the suffix first.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), raw(batch.column(1))
            for a, b in parts(texts):
                columns = zip(*cut(ids[a:b], texts[a:b], seed, rate, spm_rate))
                yield pa.record_batch([batch.column(0).slice(a, b - a), *map(pa.array, columns, types)], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    return rows.mapInArrow(run, shape).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from the output and its form alone."""
    part = F.split(output, "<[PSM]>", -1)
    of = lambda *places: F.concat(*(F.get(part, F.lit(i)) for i in places))
    return F.when(form == "plain", output).when(form == "psm", of(1, 3, 2)).otherwise(of(2, 3, 1))


def op13_middle(spark, sf_dir):
    """All ``documents`` cut and rearranged, with the hashes of the outputs and of the texts rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = transformed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by a regular expression and lists of tokens.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
  cast('0x' || substr(s, 1, 8) as bigint) as h1, cast('0x' || substr(s, 9, 8) as bigint) as h2,
  cast('0x' || substr(s, 17, 8) as bigint) as h3, cast('0x' || substr(s, 25, 8) as bigint) as h4 from d),
c as (select *, cast(len(tokens) as bigint) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b from u),
p as (select *, array_to_string(tokens[1:a], '') as pre, array_to_string(tokens[a + 1:b], '') as mid, array_to_string(tokens[b + 1:], '') as suf,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
