"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import math
import operator
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barsmith.llm import chat, components, fingerprints, lattice, licenses, mixing, packing, quality, simhash, tokens, toxicity, urls

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 97} longer{i}" for i in range(12_000))
TEXTS = ["the cat sat on the mat\nand the dog ran", None, "", "   ", "one", "a b c d e f g h", "a b c d e f g h", "ÄÖ ü ß\n\nzwei  Leer", LONG, LONG + " tail", "x\ty\x0bz\r\nq", "It's 12,5% — «ok»\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"src{i % 4}", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "src0", 0), (5, "a b c d e f g h", None, "src1", None)]
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("x"), "row": F.lit(1), "vector": F.lit(2), "size": F.lit(3), "fp": F.lit(4)})


def empty(df):
    return df.limit(0)


def test_fingerprints_by_brute_force(spark, docs):
    from barsmith.llm.fingerprints import MODULUS

    def h(*parts):
        seed = 42
        for p in parts:
            raw = p.to_bytes(4, "little", signed=True) if isinstance(p, int) and abs(p) < 1 << 20 else p.to_bytes(8, "little", signed=True) if isinstance(p, int) else p.encode()
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed

    def expected(text):
        ident = [0] * 16
        for p in text.split("\n"):
            for k in range(8):
                v = h(k, p)
                ident[2 * k] += v & (MODULUS - 1)
                ident[2 * k + 1] += v >> 32
        words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ("\n " + text.replace("\n", " \n ") + " \n").split(" ")]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        pairs = [xxhash.xxh64_intdigest(signed(b).to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(signed(a).to_bytes(8, "little", signed=True), 42)) for a, b in zip(words, words[1:])] + [xxhash.xxh64_intdigest(signed(words[-1]).to_bytes(8, "little", signed=True), 42)]
        content, signs = [], []
        for part in range(8):
            some = [p for p in pairs if p >> 61 == part]
            bits = [sum(p >> k & 1 for p in some) for k in (*range(16), *range(32, 48))]
            content += [len(some), *bits]
            signs += [2 * b - len(some) for b in bits]
        return "".join(f"{x % MODULUS:08x}" for x in ident + content), signs

    def like(a, b):
        dot = lambda x, y: sum(map(operator.mul, x, y))
        size = math.sqrt(dot(a[1], a[1]) * dot(b[1], b[1]))
        return 1.0 if a[0] == b[0] else min(1.0, max(0.0, dot(a[1], b[1]) / size)) if size else 0.0

    got = fingerprints.fingerprint_edits(docs).collect()
    small = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(small)
    want = Counter()
    for k, (i, text) in enumerate(small):
        nxt = small[(k + 1) % len(small)][1]
        n = len(text)
        edited = text[: n - n // 2] + nxt[: n // 2]
        own, other, following = expected(text), expected(edited), expected(nxt)
        want[i, n, hashlib.sha256(edited.encode()).hexdigest(), own[0], other[0], round(like(own, other), 9), round(like(own, following), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert fingerprints.fingerprint_edits(empty(docs)).count() == 0


def test_likeness_of_fingerprints_has_a_small_error(spark):
    words = [[f"w{k}x{i}" for i in range(200)] for k in range(120)]
    kept = [i % 9 / 8 for i in range(120)]
    rows = [(k, side, " ".join(w if side == 0 else w[: int(200 * kept[k])] + [f"{x}y" for x in w[int(200 * kept[k]) :]])) for k, w in enumerate(words) for side in (0, 1)]
    f = fingerprints.fingerprint(spark.createDataFrame(rows, "k int, side int, text string"), ["k", "side"])
    both = f.where("side = 0").alias("a").join(f.where("side = 1").alias("b"), "k")
    got = both.select("k", fingerprints.likeness(F.col("a.content"), F.col("b.content"), F.col("a.identity"), F.col("b.identity")).alias("like")).collect()
    errors = [r["like"] - kept[r["k"]] for r in got if 0.1 < kept[r["k"]] < 1]
    assert len(errors) > 90 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 1 / 14
    assert all(r["like"] == 1 for r in got if kept[r["k"]] == 1) and max(r["like"] for r in got if kept[r["k"]] == 0) < 0.25


def test_fingerprint_is_a_multiset_hash(spark):
    df = spark.createDataFrame([(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b\nc d"), (4, "e"), (5, "a b\nc d\nf")], "k int, text string")
    f = {r["k"]: r for r in fingerprints.fingerprint(df, ["k"]).collect()}
    assert f[1]["fingerprint"] == f[2]["fingerprint"] != f[5]["fingerprint"]
    m = fingerprints.MODULUS
    assert [(x + y) % m for x, y in zip(f[3]["identity"], f[4]["identity"])] == f[1]["identity"]
    one = spark.createDataFrame([(f[1]["identity"], f[4]["identity"], f[1]["fingerprint"])], "a array<bigint>, b array<bigint>, t string")
    r = one.select(fingerprints.delete(F.col("a"), F.col("b")).alias("less"), fingerprints.from_text(F.col("t")).alias("lanes")).first()
    assert r["less"] == f[3]["identity"] and r["lanes"] == f[1]["identity"] + f[1]["content"]


def test_licenses(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + licenses.MIT.replace("\n\n", "\n").upper()
    df = spark.createDataFrame([(1, mit), (2, licenses.MIT + " more"), (3, None), (4, "text\nreleased under the MIT Licence!\nend"), (4, "text\nreleased under the MIT Licence!\nend")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["license"], r["line_licenses"], r["n_license_lines"]) for r in licenses.scan(df).collect())
    assert got == [(1, "MIT", "", 0), (2, None, "", 0), (3, None, "", 0), (4, None, "MIT", 1), (4, None, "MIT", 1)]
    assert {r["digest"] for r in licenses.digests(spark.createDataFrame(list(licenses.KNOWN), "license string, text string")).collect()} == set(licenses.known()) - set(licenses.STANDARD)
    assert licenses.scan(empty(df)).count() == 0


@pytest.mark.parametrize("name", ["op2_licenses", "licenses_planted", "op6_url_filter", "op8_mixing"])
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = entry.queries()[name](spark, data)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def check_pieces(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [2] for k, x in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(seen[k]) == list(range(len(v))) for k, v in ids.items())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing(spark, docs):
    texts = dict(enumerate(TEXTS))
    rows = docs.where("doc_id is not null and lang is not null")
    sequences = check_pieces(packing.digest(packing.pack(rows)).collect(), texts)
    totals = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(4096 - t for t in totals if t & (t - 1)) == 0
    assert packing.pack(empty(docs)).count() == 0
    assert packing.pack(docs.where("doc_id is null")).first()["doc_id"] is None


@pytest.mark.parametrize(("capacity", "segments", "loss"), [(64, 3, 64), (64, 50, 20), (7, 1, 7), (64, 4, 64)])
def test_packer_keeps_all_limits(capacity, segments, loss):
    rng = np.random.default_rng(capacity + segments)
    p = packing.Packer(capacity, segments, loss, pool=8)
    sizes = rng.integers(1, 150, 200)
    froms = rng.integers(0, 150, 200)
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype="<u4").tobytes(), int(froms[k]))
    p.finish()
    seen, by = defaultdict(list), defaultdict(list)
    for key, start, n, total, seq, offset, bearing, ids in p.done:
        assert list(np.frombuffer(ids, "<u4")) == list(range(start, start + n)) and bearing == max(0, start + n - max(start, froms[key]))
        seen[key] += range(start, start + n)
        by[seq].append((offset, n, bearing))
    assert all(sorted(seen[k]) == list(range(n)) for k, n in enumerate(sizes))
    assert all(sum(n for _, n, _ in s) <= capacity and len(s) <= segments and sum(b for _, _, b in s) <= loss for s in by.values())


def test_tokens_by_word_are_those_of_the_text():
    w = tokens.words(tokens.default_path())
    odd = [t or "" for t in TEXTS[:8]] + ["İΣΑΣ J̌ x", "don't ,.'s RE", "é É 10 00 a0", "<|endoftext|> b", "½²x ª _a_", "$1,000.00!!"]
    assert w.by_word and w.encode(odd) == [np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def brute_classes(values, budget):
    label = np.arange(len(values))
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget)
    simhash._settle(label, a, b)
    return label


def test_simhash_of_odd_texts(spark, docs):
    def slow(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(docs, width=4).collect()
    assert len(got) == docs.count()
    want = {r["doc_id"]: f"{slow(r['text']):016x}" for r in docs.collect()}
    assert all(r["fingerprint"] == want[r["doc_id"]] for r in got)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("chunk", [4, 2048])
def test_trie_join_by_brute_force(spark, chunk, monkeypatch):
    rng = np.random.default_rng(5)
    values = []
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(25):
            v = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                v ^= 1 << int(k)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    want = brute_classes(values, 4)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    ids = values.view(np.int64).tolist()
    fps = spark.createDataFrame([(i, i) for i in ids], "fp bigint, class bigint")
    for links in (simhash.class_links(fps), simhash.class_links(fps).union(simhash.ball_links(fps))):
        root = {r["node"]: r["root"] for r in components.components(links).collect()}
        got = [root.get(i, i) for i in ids]
        assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (1, 0)]
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["root"]].add(r["node"])
    assert sorted(map(len, groups.values())) == [50, 61]
    assert components.components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).count() == 0


def test_url_intervals(spark):
    listed = spark.createDataFrame([("bad.com", "x", "2024-01-10", "add"), ("bad.com", "x", "2024-02-10", "remove"), ("a.org/p/", "y", "2024-01-01", "add"), (None, "z", "2024-01-01", "add")], "pattern string, category string, day string, action string").withColumn("day", F.to_date("day"))
    cases = [("https://www.BAD.com:80/q", "2024-01-09", ""), ("https://www.BAD.com:80/q", "2024-01-10", "x"), ("http://user@bad.com", "2024-02-09", "x"), ("http://bad.com/", "2024-02-10", ""), ("http://notbad.com/", "2024-01-11", ""), ("http://a.org/p/1", "2024-03-01", "y"), ("http://a.org/q", "2024-03-01", ""), (None, "2024-01-11", ""), ("nonsense", "2024-01-11", ""), ("http://bad.com/", None, "")]
    df = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)] * 2, "page_id int, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    got = urls.judge(df, listed).collect()
    assert len(got) == 2 * len(cases) and all(r["categories"] == cases[r["page_id"]][2] and r["blocked"] == bool(cases[r["page_id"]][2]) for r in got)
    assert urls.judge(empty(df), listed).count() == 0 and urls.judge(df, empty(listed)).where("blocked").count() == 0


def test_lattice_decoding_is_exact():
    x = np.random.default_rng(2).normal(size=(400, 8)) * 2
    near = lattice.decode(x)
    far = ((x[:, None] - near[:, None] - lattice.SHELLS[None]) ** 2).sum(-1)
    assert len(lattice.SHELLS) == 2401 and (far.argmin(1) == 0).all()


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for b in rng.normal(size=(120, 64)):
        b /= np.linalg.norm(b)
        for _ in range(4):
            n = rng.normal(size=64)
            n -= n @ b * b
            c = rng.uniform(0.93, 1)
            rows.append(c * b + np.sqrt(1 - c * c) * n / np.linalg.norm(n))
    rows += [rows[0]] * 6 + [rows[0] * 3]
    x = np.array(rows).astype("f4").astype("f8")
    odd = [(1, None), (2, [0.0] * 64), (3, [float("nan")] * 64), (4, [float("inf")] + [1.0] * 63), (5, [None] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame([(i + 10, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1))
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df, dim=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    simhash._settle(label, *np.nonzero(near))
    links = sum(got[i + 10]["n_links"] for i in range(len(x)))
    assert links <= near.sum() and links >= 0.99 * near.sum()
    assert np.mean([got[i + 10]["component_id"] == label[i] + 10 for i in range(len(x))]) > 0.98
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (1, 2, 3, 4, 5)) and got[None]["n_links"] == 0
    assert lattice.near_duplicates(empty(df), dim=64).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    words = lambda t: len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").split())
    assert len(got) == docs.count() and sum(r["size"] for r in got) == sum(words(r["text"]) for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["h"] or 0, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    by = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 50 and r["target"] <= 2 * r["size"] for r in by)
    assert abs(sum(r["target"] for r in by) - 1.5 * sum(r["size"] for r in by)) < 1e-6
    assert mixing.mix(empty(docs)).count() == 0


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.75)])
def test_classifiers(spark, docs, module, label, modulus, held, least):
    base = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = module.classify(d, l).toPandas().merge(l.toPandas(), on="doc_id")
    assert all((zlib.crc32(str(i).encode()) % modulus == held) == h for i, h in zip(got["doc_id"], got["held_out"]))
    out = got[got["held_out"]]
    assert auc(out[label].to_numpy(), out["score"].to_numpy()) > least
    # labels of the held-out fold are not learned from
    turned = l.withColumn(label, F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == held, 1 - F.col(label)).otherwise(F.col(label)))
    one = module.classify(docs, l).select("doc_id", "score", "predicted").collect()
    assert sorted(map(str, one)) == sorted(map(str, module.classify(docs, turned).select("doc_id", "score", "predicted").collect()))
    assert len(one) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in one)
    assert module.classify(empty(docs), l).count() == 0 and module.classify(docs, empty(l)).count() == docs.count()


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.5]))
    assert list(y) == sorted(y) and list(x) == sorted(x)


def test_grammar_patterns():
    r = toxicity.Reader({"idiot": 5.0})
    names = list(toxicity.FEATURES)
    for text, pattern in [("what an idiot.", "plain"), ("idiot idiot", "several"), ("you are an idiot!", "aimed"), ("he is not an idiot", "negated"), ("they said idiot", "reported"), ("i will kill them", "threat"), ("i will kill you", "aimed threat"), ("hello there", None)]:
        f = dict(zip(names, r.read(text)))
        assert {p for p in toxicity.PATTERNS if f[p] > 0} == ({pattern} if pattern else set()), text


def test_viterbi_by_brute_force():
    from itertools import product

    scores = chat.emissions(["User: hi?", "more", "fine", "Assistant: yes"], [True, False, True, True])
    path, best = chat.viterbi(scores)
    value = lambda p: chat.START[p[0]] + scores[0, p[0]] + sum(chat.TRANSITIONS[a, b] + scores[k + 1, b] for k, (a, b) in enumerate(zip(p, p[1:])))
    assert np.isclose(best.max(), max(value(p) for p in product(range(len(chat.STATES)), repeat=4))) and np.isclose(value(path), best.max())


def test_chat(spark, data):
    truth = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_turns(chat.transcript(truth))
    both = truth.join(got.where("part = 0").withColumnRenamed("role", "found"), ["conv_id", "turn"])
    right = both.where("role = found and rendered = concat('<|', role, '|>\n', text, '\n<|end|>')").count()
    assert right >= 0.97 * truth.count()
    odd = spark.createDataFrame([(1, None, "user", None), (None, 0, None, "x"), (1, 0, "user", "hello?\nthere"), (1, 0, "user", "hello?\nthere"), (2, 5_000, "assistant", "z")], "conv_id bigint, turn bigint, role string, text string").withColumn("block", F.lit(0))
    assert {r["conv_id"] for r in chat.format_turns(chat.transcript(odd)).collect()} == {1, 2, None}
    assert chat.format_turns(chat.transcript(empty(odd))).count() == 0


def test_blocks_of_a_long_conversation_agree_with_the_whole(spark, monkeypatch):
    rows = [(7, t, f"{'User' if t % 2 == 0 else 'Assistant'}: turn {t}" if t % 5 else f"turn {t}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    cut = sorted(map(tuple, chat.format_turns(df).collect()))
    monkeypatch.setattr(chat, "BLOCK", 100_000)
    assert cut == sorted(map(tuple, chat.format_turns(df).collect()))
