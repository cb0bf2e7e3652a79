"""Spelling variants: words one edit apart, found with a forward and a backward automaton, and grouped by frequency.

Of two words that differ by one inserted, deleted or replaced code point, the shorter one (either, if they are equally
long) shares its first half with the other's beginning or its second half with the other's end. So a minimal acyclic
automaton of the words is walked along the first half exactly and then completed with one error; a second automaton, of
the words reversed, does the same from the end. Both carry perfect-hash numbers (each edge knows how many words come before
those that it leads to), by which words that several paths reach count once.

Words are dealt by (length of the shorter word, half), so that all that a word may meet stand in one task, and a
task builds automata of a bounded number of words at a time. A half that more than ``CHUNK`` words share is cut into
chunks that meet in pairs. Near words are a table; the most frequent one is chosen by an aggregate, and chains of forms are
followed by doubling.

Nulls: a null text has no words, a null id is written as no digits. Rows that repeat count each time. Texts are read whole; what a
task remembers of words is bounded. Ties of frequency go to the smaller word in code-point order. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, table, written
from barsmith.llm.dealing import meetings

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Distinct words that a task counts before it passes them on, words of one automaton, and of one chunk of a half.
REMEMBERED, TOGETHER, CHUNK = 200_000, 20_000, 20_000
#: One run in so many of a document loses a code point; fewest code points and occurrences of a word; how much
#: more frequent a form is.
TYPO, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5


def runs_of(id_: int | None, text: str, typo: int) -> Counter:
    """Occurrences of each word of a document; one run in ``typo`` has lost a code point (none has for 0)."""
    found = Counter(RUN.findall(text.translate(LOWER) if not text.isascii() else text.lower()))
    if not typo:
        return found
    prefix = f"{'' if id_ is None else id_}:".encode()
    start, out = crc32(prefix), Counter()
    for run, n in found.items():
        h = crc32(run.encode(), start)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", typo: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for id_, t in zip(batch.column(0), batch.column(1)):
                if t := t.as_py():
                    for word, n in runs_of(id_.as_py(), t, typo).items():
                        if len(word) >= least_length:
                            seen[word] += n
                    if len(seen) >= REMEMBERED:
                        yield flush()
                        seen.clear()
        yield flush()

    counted = docs.select(F.col(id_col), F.col(text)).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of distinct words in order. A word's number is its place among them.

    States are numbers; ``edges[state]`` maps a letter to (next state, words passed over by taking it).
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._below: list[int] = []
        open_, before = [(False, [])], ""  # states on the path of the last word: (final, edges so far)
        for word in words:
            shared = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(word, before)))
            self._close(open_, before, shared)
            open_ += [(False, []) for _ in word[shared:]]
            open_[-1] = (True, open_[-1][1])
            before = word
        self._close(open_, before, 0)
        self.root = self._state(*open_[0])

    def _close(self, open_: list, word: str, upto: int) -> None:
        """States below the first ``upto`` letters of ``word`` are complete: each is one that is known, or a new one."""
        while len(open_) > upto + 1:
            state = self._state(*open_.pop())
            open_[-1][1].append((word[len(open_) - 1], state))

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        if key not in self._known:
            number, out = int(final), {}
            for letter, to in edges:
                out[letter] = (to, number)
                number += self._below[to]
            self._known[key] = len(self.edges)
            self.edges.append(out)
            self.final.append(final)
            self._below.append(number)
        return self._known[key]

    def follow(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        """The state after ``letters``, and the words passed over; None if there is no such path."""
        for letter in letters:
            if (step := self.edges[state].get(letter)) is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` letters of ``word`` and have one letter more or another after them."""
        found: set[int] = set()
        at = self.follow(self.root, 0, word[:exact])
        for i in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            for letter, (to, passed) in self.edges[state].items():
                rests = [word[i:]] if i == len(word) or letter == word[i] else [word[i:], word[i + 1 :]]
                for rest in rests:
                    end = self.follow(to, number + passed, rest)
                    if end and self.final[end[0]]:
                        found.add(end[1])
            at = self.follow(state, number, word[i]) if i < len(word) else None
        return found


def matched(words: dict[str, int], asking: dict[int, set[str]]) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n) for pairs that the asking words of either direction (0 forward, 1 backward) find among ``words``."""
    ways = []
    for backward in (0, 1):
        listed = sorted(w[::-1] if backward else w for w in words) if asking[backward] else []
        ways.append((Automaton(listed), [w[::-1] for w in listed] if backward else listed))
    for backward, (automaton, listed) in enumerate(ways):
        for word in asking[backward]:
            half = len(word) // 2
            found = automaton.one_error(word[::-1], len(word) - half) if backward else automaton.one_error(word, half)
            for other in map(listed.__getitem__, found):
                if backward and other[:half] == word[:half]:
                    continue  # the forward automaton finds it
                yield word, other, words[other]
                if len(other) > len(word):
                    yield other, word, words[word]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) with distinct words -> (word, near, near_n): all pairs one edit apart, both ways round."""
    size = F.char_length("word")
    roles = []
    for backward in (0, 1):
        for less in (0, 1):
            length = size - less  # of the shorter word
            half = F.floor(length / 2).cast("int")
            part = F.right("word", length - half) if backward else F.left("word", half)
            roles.append(F.struct(F.lit(backward).alias("backward"), length.alias("size"), part.alias("half"), F.lit(not less).alias("asks")))
    rows = words.select("word", "n", F.explode(F.array(*roles)).alias("r")).select("word", "n", "r.*").where("size >= 1").withColumn("class", F.xxhash64("word"))
    group = ["backward", "size", "half"]
    dealt = meetings(rows, group, "word", CHUNK).select(*group, "meet", "word", "n", "asks")
    parts = partitions(words.sparkSession)
    dealt = dealt.repartition(parts, *group, "meet").sortWithinPartitions(*group, "meet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        asking: dict[int, set[str]] = {0: set(), 1: set()}
        out: list[tuple] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            for row in matched(held, asking):
                out.append(row)
                if len(out) >= REMEMBERED:
                    yield batch_of()
            yield batch_of()
            held.clear()
            asking.update({0: set(), 1: set()})

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

        for batch in batches:
            for backward, size, half, meet, word, n, asks in zip(*(c.to_pylist() for c in batch.columns)):
                key = (backward, size, half, meet)
                if key != last and len(held) >= TOGETHER:
                    yield from flush()
                last = key
                held[word] = n
                if asks:
                    asking[backward].add(word)
        yield from flush()

    found = dealt.mapInArrow(run, "word string, near string, near_n bigint")
    return found.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) by doubling: after k rounds a word has come 2**k forms far.

    Each form is some times as frequent as its word, so chains are short; rounds end when no word moves.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n) with distinct words -> (word, form, root, n, n_near, form_n).

    The form is the most frequent near word if it is ``times`` as frequent as the word; the root is the end of the chain of forms.
    """
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    ok = F.col("form_n") >= times * F.col("n")
    rows = written(rows.withColumns({"form": F.when(ok, F.col("form")), "form_n": F.when(ok, F.col("form_n"))}), "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark, sf_dir):
    """Words of all ``documents``, in which one run in 199 of a document has lost a code point."""
    return grouped(written(vocabulary(table(spark, sf_dir, "documents"), typo=TYPO), "spelling-words"))


#: The same with words joined by what is left when a code point is taken out; the CRC is worked out byte by byte.
ORACLE = r"""
with recursive bits as (select c as i, c, 0 as k from range(256) t(c) union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents),
low as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from runs group by all),
bytes as (select *, list_concat(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':', ''), lambda x: unicode(x)),
  flatten(list_transform(string_split(r, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + (unicode(x) >> 6), 128 + unicode(x) % 64] end))) as b from low),
hashed as (select doc_id, r, n, xor(4294967295, list_reduce(b, lambda h, x: xor(h >> 8, t[1 + xor(h % 256, cast(x as bigint))]), 4294967295)) as h from bytes, crc),
typed as (select case when h % 199 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from typed where length(word) >= 6 group by word having sum(n) >= 5),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as short from gaps),
near as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.short = b.short and a.i = b.i and a.word <> b.word
  union select less.word, words.word, words.n from less join words on less.short = words.word
  union select words.word, less.word, less.n from less join words on less.short = words.word),
best as (select word, count(*) as n_near, max(near_n) as most from near group by word),
form as (select b.word, b.n_near, b.most, min(near.near) as form from best b join near on near.word = b.word and near.near_n = b.most group by all),
rows as (select w.word, w.n, coalesce(f.n_near, 0) as n_near, case when f.most >= 5 * w.n then f.form end as form, case when f.most >= 5 * w.n then f.most end as form_n from words w left join form f on w.word = f.word),
chain as (select word, word as root, 0 as k from rows union all select c.word, r.form, k + 1 from chain c join rows r on c.root = r.word where r.form is not null),
ends as (select word, max_by(root, k) as root from chain group by word)
select r.word, r.form, e.root, r.n, r.n_near, r.form_n from rows r join ends e on r.word = e.word
"""
