"""The text operators against brute force, round trips, planted cases and awkward rows."""
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from emberlog.llm import chat_format, common, jaccard_join, license_scan, mixing, packing, quality_rules, queries, secret_scan, token_counts, topk_search, toxicity
from emberlog.llm.word_ids import WordIds

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, key long, rank int, size int"
ODD = [
    (1, "a b c d", "en", "s", 7, 1, 1, 1, 1), (1, "a b c d", "en", "s", 7, 1, 1, 1, 1), (2, "A b  c\td", "en", "s", 8, 2, 2, 2, 2), (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "s", 0, 4, 4, 4, 4), (None, "x y", "en", "t", 3, 5, 5, 5, 5), (6, "word " * 30000, "fr", None, 150000, 6, 6, 6, 6), (7, "\n \n", "en", "t", 3, 7, 7, 7, 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DIR}/documents.parquet")


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DIR)
        columns = sorted(df.columns)
        listed = ", ".join(columns)
        assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, con.sql(f"SELECT {listed} FROM ({sql})").fetchall())), name


TEXT = st.text(st.sampled_from("ab 's\n\t.1é  世"), max_size=60)


@settings(deadline=None, max_examples=300)
@given(TEXT, st.lists(st.tuples(st.one_of(st.just(0), st.integers(0, 70)), st.one_of(st.just(0), st.integers(0, 20)), TEXT), max_size=5), st.sampled_from([1, 2, 32]), st.booleans())
def test_token_tree(text, edits, leaf, stored):
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    old, token_counts.LEAF = token_counts.LEAF, leaf
    try:
        tree = token_counts.TokenTree(text, count)
        for position, removed, inserted in edits:
            if stored:  # a tree made from its leaves goes on as the tree itself does
                tree = token_counts.TokenTree(tree.text, count, tree.leaves())
            tree.edit(position, removed, inserted)
            assert tree.n_tokens == len(count.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)
    finally:
        token_counts.LEAF = old


def test_insertions_at_the_start():
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tree = token_counts.TokenTree("hello world, this is a text", count)
    tree.edit(0, 0, "Title: x.\n")
    assert tree.n_tokens == len(count.encoding.encode_ordinary("Title: x.\nhello world, this is a text"))


def test_stored_trees_encode_little():
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = " ".join(f"word{i}" for i in range(20000))
    planted = token_counts.TokenTree(text, count)
    tree = token_counts.TokenTree(text, count, planted.leaves())
    assert tree.n_tokens == planted.n_tokens and tree.encoded == 0
    tree.edit(90_000, 3, " in between ")
    assert tree.encoded < 1000 and tree.n_tokens == len(count.encoding.encode_ordinary(tree.text))


def _edited(text, edits):
    for position, removed, inserted in edits:
        position = max(0, min(position or 0, len(text)))
        text = text[:position] + (inserted or "") + text[position + max(0, removed or 0) :]
    return text


def test_token_counts(spark, documents, odd):
    enc = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken")).encoding
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, DIR).collect()}
    for d, text in zip(documents.doc_id, documents.text):
        assert got[d]["n_tokens"] == len(enc.encode_ordinary(text))
        n = len(text)
        new = _edited(text, ((n // 3, 0, " a revised sentence, added in 2024.\n"), (n // 2, 40, ""), (n * 9 // 10, 5, "naïve")))
        assert got[d]["n_tokens_edited"] == len(enc.encode_ordinary(new)) == sum(got[d]["tree_tokens"]) and sum(got[d]["tree_chars"]) == len(new)


def test_token_counts_of_awkward_rows(spark, odd):
    enc = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken")).encoding
    edits = [(0, 0, "x"), None, (None, None, None), (-3, -1, "y"), (10**6, 5, "z"), (1, 2, None)]
    asked = "array(" + ",".join("null" if e is None else f"named_struct('position', {'null' if e[0] is None else e[0]}, 'removed', {'null' if e[1] is None else e[1]}, 'inserted', {'null' if e[2] is None else repr(e[2])})" for e in edits) + ")"
    trees = token_counts.plant(odd)
    twice = token_counts.edit(token_counts.edit(trees, asked), asked)
    texts = {r["id"]: (r["text"], r["n_tokens"], r["n_edits"]) for r in twice.collect()}
    done = [e for e in edits if e is not None]
    for r in ODD:
        want = _edited(_edited(r[1] or "", done), done)
        assert texts[r[0]] == (want, len(enc.encode_ordinary(want)), 5)
    same = token_counts.edit(trees, "cast(null as array<struct<position:int,removed:int,inserted:string>>)").collect()
    assert sorted((str(r["id"]), r["text"], r["n_tokens"]) for r in same) == sorted((str(r["id"]), r["text"], r["n_tokens"]) for r in trees.collect())
    assert token_counts.edit(token_counts.plant(odd.limit(0)), asked).count() == 0


def test_quality_removes_lines(spark):
    line = "the same footer line of this host"
    rows = [(i, f"own words of document number {i} come here first\n{line.upper()}", "h") for i in range(30)] + [(99, line, "h"), (100, line, "other"), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in quality_rules.remove_lines(docs).collect()}
    assert 99 not in out and out[100] == line and out[3] == "own words of document number 3 come here first" and out[101] is None
    copies = spark.createDataFrame([(i, "a whole text copied often", "h") for i in range(50)], "doc_id long, text string, source string")
    assert quality_rules.line_frequency(copies).filter("depleted").count() == 50
    assert quality_rules.line_frequency(copies, texts=True).filter("depleted").count() == 0
    # rows of one id are one document; rows without an id are documents each
    assert quality_rules.line_frequency(copies.withColumn("doc_id", F.lit(7))).filter("depleted").count() == 0
    assert quality_rules.line_frequency(copies.withColumn("doc_id", F.lit(None))).filter("depleted").count() == 50


def _lost(rows, max_docs):
    """Words on lines above the limit, by brute force."""
    who = defaultdict(set)
    lines = [[(host, " ".join(re.sub("[A-Z]", lambda m: m.group().lower(), line).encode().decode().split()), len(line.split())) for line in (text or "").split("\n") if line.split()] for _, text, host in rows]
    for i, ((key, _, _), own) in enumerate(zip(rows, lines)):
        for host, line, _ in own:
            who[host, line].add(("d", key) if key is not None else ("r", i))
    return sorted((str(key), sum(n for host, line, n in own if len(who[host, line]) > max_docs)) for (key, _, _), own in zip(rows, lines))


def test_line_frequency_with_hot_lines(spark, odd, monkeypatch):
    r = random.Random(4)
    pool = [f"line {k} of all" for k in range(40)]
    rows = [(r.choice([None, i, i, i // 2]), "\n".join(r.choices(pool, [200 // (k + 1) + 1 for k in range(40)], k=r.randrange(6))) or None, r.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for hot in (1, 8, 4096):  # none, some and all of the frequent lines are hot
        monkeypatch.setattr(quality_rules, "HOT", hot)
        got = quality_rules.line_frequency(docs, max_docs=12).select("doc_id", "removed_words").collect()
        assert sorted((str(x["doc_id"]), x["removed_words"]) for x in got) == _lost(rows, 12)
    out = quality_rules.remove_lines(odd.withColumn("rid", F.col("key")).withColumn("hash", F.lit("x")))
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "rid", "hash"] and out.filter("doc_id = 6").first()["rid"] == 6
    assert quality_rules.line_frequency(odd).count() == len(ODD) and quality_rules.remove_lines(odd.limit(0)).count() == quality_rules.line_frequency(odd.limit(0)).count() == 0


@given(st.text(st.sampled_from("<s>/[INT]\\ ok\n"), max_size=40))
def test_escapes(text):
    got = chat_format.escape(text)
    assert chat_format.unescape(got) == text and not any(c in got for c in chat_format.CONTROLS)


def test_prefix_forest(spark):
    shared = [("system", "be good"), ("user", "hi </s> there")]
    convs = {i: [*shared, ("assistant", f"answer {i % 3}"), ("user", f"more {i}")] for i in range(12)} | {50: shared, 51: [("user", None)]}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, paths = chat_format.prefix_forest(turns)
    found = nodes.collect()
    assert len(found) == len({tuple(map(str, t[: k + 1])) for t in convs.values() for k in range(len(t))})
    by = {r["node"]: r for r in found}
    for r in found:
        spans, up = set(), r
        while up["parent"] is not None:
            up = by[up["parent"]]
            spans |= {(up["range"], up["first"] + i) for i in range(len(up["ids"]))}
        assert {(a["range"], i) for a in r["ancestors"] for i in range(a["from"], a["to"])} == spans and r["positions_from"] == len(spans)
    got = {r["conv_id"]: r for r in chat_format.read_back(nodes, paths).collect()}
    for c, t in convs.items():
        said = "".join(x or "" for r, x in t if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x or ''}\n" for r, x in t).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_of_awkward_rows(spark):
    long = "word </s> " * 50_000
    rows = [(None, 1, "user", "a"), (None, 2, None, None), (1, None, "assistant", "x"), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, "user", long), (2, 1, "assistant", "é\\ [INST]"), (3, 0, "user", long), (3, 1, "assistant", "other")]
    turns = spark.createDataFrame([(*r, b"x", 5) for r in rows], "conv_id long, turn long, role string, text string, node binary, k long")
    nodes, paths = chat_format.prefix_forest(turns)
    got = {r["conv_id"]: r for r in chat_format.read_back(nodes, paths).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own = sorted(own, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert nodes.filter(F.size("ids") > 50_000).count() == 1  # the long turn is emitted once
    none = chat_format.prefix_forest(turns.limit(0))
    assert none[0].count() == none[1].count() == chat_format.read_back(*none).count() == 0


def test_mixing(spark, odd):
    rows = [r.asDict() for r in queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()]
    again = [r.asDict() for r in queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()]
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(docs.doc_id, docs.text)}
    source = dict(zip(docs.doc_id, docs.source))
    sums = Counter()
    for d, n in size.items():
        sums[source[d]] += n
    goal, open_ = {}, {s: 1 + i % 3 for i, s in enumerate(sorted(sums))}
    left = sum(sums.values())
    while True:  # resharing as the contract says it
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 3 * sums[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * sums[s]
            left -= goal[s]
            del open_[s]
    goal |= {s: level * w for s, w in open_.items()}
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert math.isclose(r["target"], goal[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    assert all(abs(taken[s] - goal[s]) <= max(size[d] for d in size if source[d] == s) / 2 for s in goal)
    assert mixing.mix(odd).count() == len(ODD) and mixing.take(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_keeps_expectations(spark):
    sizes = (40, 30, 20, 20, 12, 9, 7, 5, 3, 2, 1, 1)
    rows = [(12 * k + i, "w " * n, f"s{k:04}") for k in range(900) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs, weights=(1, 2, 4)).toPandas()
    got["want"] = got.target / got.source_size
    got["kind"] = got.id % 12
    for (want, kind), part in got.groupby(["want", "kind"]):
        # the last fraction of a source is rounded to the nearer integer, so only its document may be off its mean
        if sizes[kind] > 3:
            assert abs(part.times.mean() - want) < 4 * 0.5 / math.sqrt(len(part)) + 0.01, (want, kind, part.times.mean())
    assert got.times.between(0, 3).all()
    sums = got.assign(taken=got.times * got["size"]).groupby("src").agg({"taken": "sum", "target": "first"})
    assert ((sums.taken - sums.target).abs() <= 20).all() and ((sums.taken - sums.target).abs() <= 4).mean() > 0.9


def _fold(items, us, cap=3):
    """A block's fold, in plain numbers: what the pool gains and loses is shared document by document."""
    x = [y for _, y in items]
    for k, ((s, _), u) in enumerate(zip(items, us)):
        rest, w = range(k + 1, len(items)), math.floor(x[k] + mixing.EDGE)
        mass, room = sum(x[j] * items[j][0] for j in rest), sum((cap - x[j]) * items[j][0] for j in rest)
        up, down = min((w + 1 - x[k]) * s, mass), min((x[k] - w) * s, room)
        if x[k] - w <= mixing.EDGE or up + down <= 0:
            continue
        if u * (up + down) < down:
            x[k] = w + 1.0 if up < mass else x[k] + up / s
            for j in rest:
                x[j] -= up / mass * x[j]
        else:
            x[k] = float(w) if down < room else x[k] - down / s
            for j in rest:
                x[j] += down / room * (cap - x[j])
    return x


def test_mixing_fold(spark):
    r = random.Random(9)
    blocks = [sorted(((r.choice([1, 3, 40, 2000]), r.choice([0.5, 0.01, 1.0, 2.99, 3 * r.random()])) for _ in range(r.randrange(1, 12))), reverse=True) for _ in range(400)]
    rows = [(k, [(-s, i, i, 1, s, x) for i, (s, x) in enumerate(b)], 5 + k, 3) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, f"k int, items array<{mixing.ITEM}>, seed int, cap int")
    us = "transform(items, x -> pmod(xxhash64(x.h, x.id, x.r, x.s, seed), 9007199254740992L) / 9007199254740992D)"
    for k, got, u in df.selectExpr("k", f"transform({mixing.FOLD}, x -> x.x)", us).collect():
        assert np.allclose(got, _fold(blocks[k], u), atol=1e-6)
        assert math.isclose(sum(s * x for (s, _), x in zip(blocks[k], got)), sum(s * x for s, x in blocks[k]), rel_tol=1e-9)
        assert sum(abs(x - round(x)) > 1e-6 for x in got) <= 1 and all(0 <= x <= 3 for x in got)


def test_secrets(spark, odd):
    key = "q8Zr2LwX7bTn4VdK"
    text = f'token = "{"0123456789abcdef" * 2}" AKIA{"Q" * 16} pwd: {key} password is welcome1 secret: token=short'
    base, every = secret_scan.spans(text)
    assert [k for _, _, k in base] == ["assign", "hex", "access"]
    assert [text[a:b] for a, b, k in every if k == "guess"] == [key]
    for weak in ("password123", "qwertyuiop", "aaaaaaaaaaaa", "2024-05-01", "letmein2023"):
        assert secret_scan.guess_cost(weak) < 9 < secret_scan.guess_cost(key)
    out = secret_scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert key not in out and "AKIA" not in out and 'token = "[secret]"' in out and "welcome1" in out
    assert secret_scan.scan(odd).count() == secret_scan.redact(odd).count() == len(ODD)


def test_base_spans_of_documents(spark, documents):
    patterns = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        "access": (r"AKIA[A-Z0-9]+", 0, 18),
        "hex": (r"[0-9a-f]+", 0, 16),
    }
    got = {r["doc_id"]: r for r in queries.op5_secret_scan(spark, DIR).collect()}
    for d, text in zip(documents.doc_id, documents.text):
        found = [(m.start(), i, m.end(), k) for i, (k, (p, g, least)) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in patterns] == [sum(x.startswith(k) for x in base) for k in patterns]
        assert [x for x in got[d]["spans"].split(",") if x and not x.startswith("guess")] == base


def test_secrets_of_awkward_texts(spark):
    key = "q8Zr2LwX7bTn4VdK"
    long = "x " * 200_000 + f"pwd: {key}"
    rows = [(1, None), (1, None), (2, ""), (3, long), (None, f"pwd: {key}"), (4, "İ" * 50 + f" pwd: {key} İ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), [(x["start"], x["stop"], x["kind"]) for x in r["spans"]]) for r in secret_scan.scan(docs).collect())
    assert got == [("1", []), ("1", []), ("2", []), ("3", [(400_005, 400_021, "guess")]), ("4", [(56, 72, "guess")]), ("None", [(5, 21, "guess")])]
    assert secret_scan.scan(docs.limit(0)).count() == secret_scan.redact(docs.limit(0)).count() == 0


@given(st.text(st.sampled_from("ab1!q"), max_size=9))
def test_guess_cost_is_least(value):
    cost = secret_scan.guess_cost(value)
    assert 0 <= cost <= sum(math.log10({"1": 10, "!": 33}.get(c, 26)) for c in value) + 1e-9


PROSE = (
    "The secret is patience", "The token is generated by the server", "Compass: northwest", "Kompass: Nordwesten", "spin: clockwise", "The password is incorrect.",
    "password: obligatoire", "token: abgelaufen", "pin: erforderlich", "token is obligatorio", "secret is contraseña",
)


def test_prose_is_no_secret(spark):
    docs = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()} == dict(enumerate(PROSE))
    for text in ("dbPassword: Xq93kfpLw2", "accesstoken=Xq93kfpLw2", "DB_PASS=Xq93kfpLw2", "the pin is Xq93kfpLw2", "password is correcthorsebatterystaple"):
        assert [k for _, _, k in secret_scan.spans(text)[1]] == ["guess"], text


def _cost_by_all_runs(value, words):
    """The same costs with every sub-run offered."""
    n, low, rank = len(value), value.lower(), secret_scan.ranked(words)[0]
    plain, join = low.translate(secret_scan.LEET), secret_scan.JOIN

    def walk(x):
        step = 0
        for a, b in zip(x, x[1:]):
            d = ord(b) - ord(a)
            if not (secret_scan._adjacent(a, b) or (a.isalnum() and b.isalnum() and abs(d) == 1 and step in (0, d))):
                return False
            step = d if abs(d) == 1 else step
        return len(x) >= 3

    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            x, costs = low[i:j], [sum(math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in value[i:j])]
            if plain[i:j] in rank and j - i >= 2:
                costs.append(rank[plain[i:j]] + 0.3 * (value[i:j] != x) + 0.5 * (plain[i:j] != x))
            costs += [k * math.log10(36) + math.log10((j - i) / k) for k in (1, 2, 3, 4) if j - i >= max(3, 2 * k) and x[k:] == x[:-k]]
            costs += [math.log10(40) + 0.35 * (j - i)] if walk(x) else []
            costs += [secret_scan.SEPARATOR] if x in secret_scan.SEPARATORS and 0 < i < n - 1 else []
            best[j] = min(best[j], best[i] + join * (i > 0) + min(costs))
    return best[n]


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("abcgreqwn12-A"), min_size=1, max_size=14))
def test_guess_cost_offers_every_run(value):
    words = ("green", "grab", "ab", "cab")
    assert math.isclose(secret_scan.guess_cost(value, words), _cost_by_all_runs(value, words))


def test_topk_brute(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (350, [0.0] * 6)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), "vec_id % 50 = 0", query_block=2, rows_block=64).collect()
    good = {i: v for i, v in rows if v and len(v) == 6 and not any(math.isnan(x) for x in v)}
    for q in [i for i in good if i % 50 == 0]:
        want = sorted((-int(np.dot(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        assert [(x["score"], x["vec_id"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [(-s, i) for s, i in want]


def _top(rows, is_query, k=5):
    good = [(i, v) for i, v in rows if i is not None and v and not any(x is None or math.isnan(x) or math.isinf(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if is_query(i)}:
        best = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_of_awkward_rows(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in (0, 0, 1, 2, 3, 50, 50, 51, None, 4, 4)]
    rows += [(0, rows[0][1]), (7, None), (8, []), (100, [float("inf"), 1.0, 1.0]), (100, [1.0] * 4), (9, [2.0] * 4), (150, [1.0])]  # 150 meets nobody
    for size in (1, 3, 100):
        got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), "vec_id % 50 = 0", rows_block=size, query_block=2)
        assert sorted(tuple(x) for x in got.collect()) == _top(rows, lambda i: i % 50 == 0)
    # columns of the names that are used inside, a condition over another column, an empty table
    docs = spark.createDataFrame([(i, v, 1, 2, i == 3) for i, v in rows], "vec_id long, vector array<double>, id int, block int, q boolean")
    assert sorted(tuple(x) for x in topk_search.top_k(docs, "q").collect()) == _top(rows, lambda i: i == 3)
    assert topk_search.top_k(docs.limit(0), "q").count() == 0


def test_topk_scores_are_exact_to_64_bits(spark):
    r = random.Random(2)
    for most in (2**20, 2**29, 2**31 - 1, 2**40):
        rows = [(i, [r.randint(-most, most) // (10**6 if most > 2**35 and k else 1) for k in range(2)]) for i in range(40)]
        rows = [(i, [a if most < 2**35 else a // 2**20, b]) for i, (a, b) in rows]
        got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), "vec_id < 5", k=3)
        assert sorted(tuple(x) for x in got.collect()) == _top(rows, lambda i: i < 5, 3)
    huge = topk_search.SortedLists(np.arange(3), np.full((3, 4), 2**40))
    with pytest.raises(OverflowError):
        huge.search(np.full(4, 2**40), None, 1)
    assert topk_search.SortedLists(np.arange(2), np.array([[2**40, 1], [-(2**40), 5]])).search(np.array([2**40, 0]) // 2**20, None, 1) == [(2**60, 0)]


def test_licenses(spark, documents, odd):
    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))

    texts = [*documents.text, "Under the MIT license, under the mit-license CC BY NC cc by nc", "x", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t or "")
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    n = len(documents)
    assert (got[n + 2]["labels"], got[n + 3]["labels"]) == ("gpl-3", "bsd-3")
    assert license_scan.scan(odd).count() == len(ODD)


LICENSES = {
    "License: Apache License 2.0": "apache-2",
    "License: GPLv3": "gpl-3",
    "License: MIT": "mit",
    '"license": "ISC"': "isc",
    "Microsoft Public License": "ms-pl",
    "It carries the SIL Open Font License.": "ofl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": "gpl-3-or-later",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "gpl-2",
    "under the GNU Lesser General Public License version 2.1 or later": "lgpl-2.1-or-later",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
    "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl-3-or-later",
    "governed by version 2 of the GNU General Public License": "gpl-2",
    "Governed by the Eclipse Public License - v 2.0": "epl-2",
    "MPL-2.0": "mpl-2",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE": "0bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met: 1. x 2. y provided with the distribution. THIS SOFTWARE IS PROVIDED": "bsd-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that: y provided with the distribution. 3. Neither the name may be used to endorse or promote products": "bsd-3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that: 3. All advertising materials mentioning features 4. Neither the name may be used to endorse or promote products": "bsd-4",
    "Das steht unter der License mit der Ausnahme, dass es mit Wasser geht.": "",
    "we met at the zlib, openssl and python 2.0 booth; an MPL example": "",
}


def _shortest(parsed):
    """The shortest text of a parsed regex."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += "a" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            case "NOT_LITERAL":
                out += "a"
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += _shortest(arg[2]) * arg[0]
            case "SUBPATTERN":
                out += _shortest(arg[3])
            case "BRANCH":
                out += min((_shortest(x) for x in arg[1]), key=len)
            case "ASSERT" | "ASSERT_NOT":
                pass
            case _:
                raise ValueError(op)
    return out


def test_license_signatures(spark):
    docs = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(LICENSES)} == LICENSES


def _detections(text):
    """Labels, score and detections by brute force: every rule on every text, without gates."""
    norm = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")).strip(" ") + " "
    found = []
    for rule in license_scan.rules():
        if rule["keyword"] in norm:
            for m in re.finditer(rule["regex"], norm):
                start = norm.count(" ", 0, m.start())
                found.append((start, -(start + m.group().count(" ")), rule["priority"], rule["label"], rule["weight"]))
    found.sort()
    kept = [x for i, x in enumerate(found) if not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
    base = {label for phrase, label in license_scan.BASE if f" {phrase} " in norm}
    return ",".join(sorted(base | {x[3] for x in kept})), max([0.9 * bool(base), *(x[4] for x in kept)]), [(a, -b, p, k, w) for a, b, p, k, w in kept]


def test_license_labels_and_score(spark, documents):
    licensed = [x for x in documents.text if re.search("(?i)licen[sc]|copyright|gpl|cc by|cc-by|permission", x)][:40]
    texts = [*LICENSES, " ".join(LICENSES), *licensed, *documents.text[:10], "cc by nc " * 30, "accept success cc", "CC-BY 4.0, cc0, cc.by.sa", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        assert (r["labels"], r["score"], [tuple(x) for x in r["detections"]]) == _detections(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_licenses_of_a_long_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "cc by nc " * n), (2, "gpl " * n), (3, "")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in license_scan.scan(docs).select("doc_id", "n_base", "last_word", "labels", F.size("detections").alias("n")).collect()}
    assert time.monotonic() - began < 60
    assert (got[1]["n_base"], got[1]["last_word"], got[1]["labels"]) == (n, 3 * n - 3, "cc-by-nc") and got[2]["n"] >= n / 2 and got[3]["labels"] == ""


def test_license_gates_and_keywords():
    for r in license_scan.rules():
        text = _shortest(re._parser.parse(r["regex"]))
        assert re.search(r["regex"], text + " ") and r["keyword"] in text + " "
        assert any(g in text for g in license_scan.GATES) or re.search(license_scan.SHORT_GATES, text + " "), r


def test_word_ids_equal_the_tokenizer(documents):
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*documents.text[:60], "ΣΑΣ <|endoftext|> \x1c x y don't 世界 é", ""]
    for text, got in zip(texts, ids.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_of_all_letters():
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}Q {chr(c)} .{chr(c)}-" for c in [*range(0x600), *range(0x600, 0xD000, 97), *range(0xE000, 0x1FFFF, 97)]]
    for text, got in zip(texts, ids.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert ids.encode([]) == [] and ids.encode(["", " ", "a"])[:2] == [b"", b""]


def test_packing(spark, documents, odd):
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op8_packing(spark, DIR).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in zip(documents.doc_id, documents.text):
        data = ids.encode([text])[0] + b"\0\0\0\0"
        at = 0
        for i, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(data)
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    whole = packing.pack(spark.read.parquet(f"{DIR}/documents.parquet")).select("length", "ids", "ids_crc32").collect()
    for r in whole:  # the ids are those that the checksum is of
        got = np.frombuffer(r["ids"], "<u2")
        assert len(got) == r["length"] and zlib.crc32(got.astype("<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(odd, length=16).filter("offset + length > 16").count() == 0 and packing.pack(odd.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(0, 9), max_size=12))
def test_supersteps_are_best_fit_decreasing(counts):
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(30 - s)
    assert packing.supersteps(counts, 30)[1] == len(gaps)


def test_toxicity(spark, odd):
    words = [f"w{i}" for i in range(300)]
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(words, k=40)) + (" scum" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas().set_index("doc_id").score
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (y == 1) for i, y in held) / len(held) > 0.97
    assert toxicity.score(odd, toxicity.fit(docs, labels)).count() == len(ODD)
    assert toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).agg({"score": "max"}).first()[0] == 0


def _train(rows, alpha, beta, l1, l2, epochs):
    """FTRL-proximal, coordinate by coordinate; coordinate None is the bias, which has no penalty."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        pull = 0.0 if i is None else l1
        if abs(z[i]) <= pull:
            return 0.0
        return -(z[i] - math.copysign(pull, z[i])) / ((beta + math.sqrt(n[i])) / alpha + (0.0 if i is None else l2))

    for _ in range(epochs):
        for places, y in rows:
            w = {i: weight(i) for i in [None, *places]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, v in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * v
                n[i] += g * g
    return {i: weight(i) for i in z if i is not None and weight(i)}, weight(None)


def test_ftrl_equals_the_scalar_form():
    r = random.Random(5)
    rows = [(sorted(r.sample(range(60), r.randrange(1, 9))), r.randrange(2)) for _ in range(300)]
    rows = [(f, int(y or 7 in f)) for f, y in rows]
    for how in ({"alpha": 1.0, "beta": 1.0, "l1": 0.5, "l2": 0.1, "epochs": 2}, {"alpha": 0.3, "beta": 1.0, "l1": 2.0, "l2": 0.0, "epochs": 3}):
        model = toxicity.train([(np.array(f), y) for f, y in rows], bits=6, **how)
        weights, bias = _train(rows, **how)
        assert math.isclose(model.bias, bias, rel_tol=1e-9) and set(model.places.tolist()) == set(weights)
        assert all(math.isclose(w, weights[p], rel_tol=1e-5) for p, w in zip(model.places.tolist(), model.weights.tolist()))


def test_toxicity_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, held_out=False)
    scored = toxicity.score(odd.withColumn("score", F.lit("old")).withColumn("_y", F.lit(1)), model)
    assert sorted(scored.columns) == sorted([*odd.columns, "score", "_y"])
    got = scored.collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    bias = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(bias) == 1 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1  # no words; repeated rows
    assert toxicity.score(odd.limit(0), model).count() == 0 and not toxicity.fit(odd.limit(0), labels, held_out=False).trained


def test_running_sums(spark):
    r = random.Random(6)
    rows = [(r.choice([None, f"s{i}"]) if i == 7 else f"s{i}", r.randrange(100)) for i in range(300)]
    got = common.running(spark.createDataFrame(rows, "src string, n long").repartition(7), [F.col("src").asc_nulls_last()], before="n").collect()
    want, total = [], 0
    for place, (src, n) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or "")), 1):
        want.append((src, n, place, total))
        total += n
    assert sorted(((x["src"], x["n"], x["place"], x["before"]) for x in got), key=lambda x: x[2]) == want
    assert common.running(spark.createDataFrame([], "src string, n long"), [F.col("src").asc()], before="n").count() == 0


def test_sweep_deletes_spooled_tables(spark):
    one, two = (common.spool(spark.range(5)) for _ in range(2))
    common.sweep(spark, two)
    assert two.count() == 5 and not os.path.exists(one.spooled.removeprefix("file://")) and os.path.exists(two.spooled.removeprefix("file://"))


def test_workers_let_go():
    toxicity.begin()
    toxicity.features("some words")
    toxicity.begin()
    assert toxicity._hashes
    jaccard_join.begin()
    assert not toxicity._hashes


def _classes(texts, width, percent):
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for i, t in texts.items() for w in [(t or "").lower().split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and jaccard_join.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), percent):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, odd):
    r = random.Random(7)
    texts = {}
    for g in range(40):
        base = [f"t{r.randrange(500)}" for _ in range(r.choice([1, 2, 4, 9, 12, 30, 120]))]
        for _ in range(r.choice([1, 2, 5])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = f"x{r.randrange(500)}"
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80), (2, 60)):
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.near_duplicates(docs, width=width, percent=percent, block=2, blocks=3).collect()}
        assert got == _classes(texts, width, percent)
    assert jaccard_join.near_duplicates(odd).count() == len(ODD) and jaccard_join.near_duplicates(odd.limit(0)).count() == 0
    kept = jaccard_join.keep_one(odd, width=3)
    assert kept.columns == odd.columns and sorted(x["doc_id"] or -1 for x in kept.collect()) == [-1, 1, 3, 4, 6, 7]


def test_keep_one_judges_rows(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(5, x), (5, y), (3, y + " more"), (None, x), (None, z), (None, z), (None, None), (None, None), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__rid_0", F.lit(1))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, x), (3, y + " more"), (None, z), (None, None), (None, None), (8, ""), (9, None)], key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_loose_members_of_large_tiles(spark, monkeypatch, hot):
    if hot:  # keys and hubs count as hot from a few rows on
        for name, value in (("LOOK", 2), ("OFTEN", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(11)
    texts, words = {}, [f"t{k}" for k in range(60)]
    for i in range(240):  # a drifting chain: few are linked to any one hub
        texts[i] = " ".join(words)
        words[r.randrange(60)] = f"x{i}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for percent in (80, 90):
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.near_duplicates(docs, width=2, percent=percent, block=1, blocks=9).collect()}
        assert got == _classes(texts, 2, percent)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (5, 5)]
    got = {x["node"]: x["root"] for x in jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DIR))
        if name != "packing":
            assert out[-1].columns == docs.columns
    clean, near, safe, mixed, packed = (x.toPandas() for x in out[1:])
    assert set(documents.doc_id) - set(clean.doc_id) <= set(labels[labels.toxic == 1].doc_id) | set(documents.doc_id) - set(labels.doc_id)
    classes = _classes({d: re.sub("[A-Z]", lambda m: m.group().lower(), t) for d, t in zip(clean.doc_id, clean.text)}, 5, 80)
    assert sorted(near.doc_id) == sorted(set(classes.values()))
    assert dict(zip(safe.doc_id, safe.text)) == {d: secret_scan.redact(spark.createDataFrame([(t,)], "text string")).first()[0] if secret_scan.spans(t)[1] else t for d, t in zip(near.doc_id, near.text)}
    assert set(mixed.doc_id) <= set(safe.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    assert sorted(packed[packed.piece == 0].doc_id) == sorted(mixed.doc_id)


def test_pipeline_of_awkward_rows(spark, odd, tmp_path):
    """Every stage alone, and all of them, on nulls, empty and long texts, repeated rows, clashing columns and no rows."""
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 0)], "doc_id long, quality int, toxic int".replace("quality int, ", ""))
    columns = list(corpus_pipeline.COLUMNS)
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        at = f"{tmp_path}/{name}"
        docs.select(*columns).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        for stage, run in corpus_pipeline.STAGES:
            got = run(spark, docs, at)
            n = got.count()
            assert stage == "packing" or got.columns == columns, stage
            # a, b, c, d twice is one text of two ids; rows without words stay but for mixing
            assert n == (0 if name == "none" else {"toxicity": 8, "near_duplicates": 6, "secrets": 8}.get(stage, n)), stage
            assert name == "none" or n > 0
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in packed} <= {1, 6, None} and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_run_equals_brute_force(spark, documents):
    """run() against its stages by brute force: kept documents, their ids, and how often each is packed."""
    packed = corpus_pipeline.run(spark, DIR).toPandas()
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score(docs, toxicity.fit(docs, labels, held_out=False)).toPandas().set_index("doc_id").score
    clean = {d: t for d, t in zip(documents.doc_id, documents.text) if scores[d] < 0.5}
    classes = _classes({d: re.sub("[A-Z]", lambda m: m.group().lower(), t) for d, t in clean.items()}, 5, 80)
    ids, count = WordIds(public_tokenizers.path("word_bpe_49k.json")), Counter(packed[packed.piece == 0].doc_id)
    assert set(count) <= set(classes.values()) and max(count.values()) <= 3
    for d, parts in packed.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        text = clean[d]
        for a, b, kind in reversed(secret_scan.spans(text)[1]):  # no two overlap in these texts but where one holds the other
            a = secret_scan.BASE[0][1].match(text, a).start(2) if kind == "assign" else a
            text = text[:a] + "[secret]" + text[b:] if "[secret]" not in text[a:b] else text
        want = ids.encode([text])[0] + b"\0\0\0\0"
        assert parts[parts.piece == 0].ids_crc32.nunique() == 1 and parts.groupby("piece").length.first().sum() * 4 == len(want), d
    taken, source = Counter(), dict(zip(documents.doc_id, documents.source))
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", clean[d])) for d in set(classes.values())}
    sums = Counter()
    for d, n in size.items():
        sums[source[d]] += n
    for d, k in count.items():
        taken[source[d]] += k * size[d]
    assert all(taken[s] <= 3 * sums[s] for s in sums)
