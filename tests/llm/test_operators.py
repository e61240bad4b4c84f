"""Each operator against brute force on whole small tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import exact_dedup, jaccard, licenses, mixing, packing, quality, substrings, syncmers, toxicity, warc
from pixelloom.llm import common as C

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return helpers.documents(spark)


@pytest.fixture(scope="module")
def texts(docs):
    return helpers.texts(docs)


# packing


def check_packed(rows, texts_by_row):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    for doc_id, text in texts_by_row.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]}) == want
    return len(by_sequence)


def test_packing(docs, texts):
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    used = check_packed(rows, texts)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd(spark):
    rows = packing.pack_documents(helpers.odd(spark), TOKENIZER).collect()
    check_packed(rows, {r[0]: r[1] for r in helpers.ROWS if r[0] not in (None, 2)})
    assert sum(r.piece == 0 for r in rows) == len(helpers.ROWS)
    assert packing.pack_documents(helpers.empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100 if seed % 2 else 4097, 3000 if seed else 7)
    histogram = {int(v): int(n) for v, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    filled, count = defaultdict(list), defaultdict(int)
    for length, first, n, base, each, offset in packing.plan(histogram):
        assert first == count[length]
        count[length] += n
        for k in range(n):
            filled[base + k // each].append((offset + k % each * length, length))
    assert dict(count) == histogram
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= 1.03 * -(-int(lengths.sum()) // 4096) + 1


def test_word_memory_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    cases = ["a b ć éx 's don't I'LL <|endoftext|> x<|startoftext|>y İstanbul ΣΑΣ b\x0bc\x1cd\x85e", "​ \t\t\r\n\x0c z", "각 한", "ſK Å", "", " ", "it's 12'34 a''s", "éÀ×÷ ß"]
    for text in cases * 2:
        assert packing.token_ids(TOKENIZER, text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# licenses


def places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(docs, texts):
    rows = licenses.scan_licenses(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {k: places(t) for k, t in texts.items()}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_licenses_overlap_and_expressions(spark):
    cases = {
        1: "CC BY CC-BY cc by",
        2: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */",
        3: "The MIT\nLicense; mit licensee; GNU General Public License",
        4: "SPDX-License-Identifier: GPL-3.0-or-later AND MIT",
        5: None,
        6: "spdx-license-identifier: ) or",
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for k, t in cases.items():
        assert (rows[k].n_words, rows[k].n_base, rows[k].first_word, rows[k].last_word, rows[k].base_labels) == places(t or "")
    assert rows[1].n_base == 3
    assert rows[2].expressions == "mit gpl-2.0-only classpath-exception-2.0 with or apache-2.0 and" and rows[2].permissive
    assert rows[4].permissive is False and rows[6].expressions == "" and rows[5].labels == ""
    assert len(licenses.scan_licenses(helpers.odd(spark)).collect()) == len(helpers.ROWS)


def test_expressions_by_truth_table():
    for text, formula in [("a or b and c", lambda a, b, c: a or b and c), ("(a or b) and c", lambda a, b, c: (a or b) and c), ("a with x and b or c", lambda a, b, c: a and b or c), ("((a))", lambda a, b, c: a)]:
        for k in range(8):
            a, b, c = (bool(k >> i & 1) for i in range(3))
            allowed = {n for n, v in zip("abc", (a, b, c), strict=True) if v}
            assert licenses.evaluate(licenses.to_postfix(text), allowed.__contains__) == formula(a, b, c)
    assert licenses.to_postfix("mit and") == ["mit"] and licenses.to_postfix("(mit") is None


# archives


def test_many_tags_in_linear_time(spark):
    got = licenses.scan("SPDX-License-Identifier:\n" * 20000 + "SPDX-License-Identifier: ISC", licenses.automaton(), {"isc"}.__contains__)
    assert got[5] == "isc" and got[8] is True
    assert licenses.scan("SPDX-License-Identifier: (\n" * 20000, licenses.automaton(), {"isc"}.__contains__)[7] == ""
    assert licenses.scan_licenses(helpers.empty(spark)).count() == 0


def test_expressions_before_long_lines():
    for n in (60, 64, 66, 67, 5000):
        assert licenses.to_postfix("(MIT OR ISC) AND zlib " + "word " * n) == ["mit", "isc", "or", "zlib", "and"]
    line = "SPDX-License-Identifier: MIT " + "and so it goes on " * 100
    got = licenses.scan(line, licenses.automaton(), {"mit"}.__contains__)
    assert got[5] == "mit,so" and got[7] == "mit so and" and got[8] is False


def test_warc(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(900, "u", None), (901, "u", ""), (902, None, "WARC/1.1\r\n\r\n\r\n\r\n"), (903, "a\r\nb", "same"), (904, "u", "same"), (905, "u", "same"), (906, "u", "é \0")], "page_id long, url string, html string")
    pages = pages.unionByName(more)
    path = C.fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.resolve_records(C.materialize(warc.read_archives(spark, path), "records")).collect()}
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for k in sorted(html):
        last[html[k]] = k
    assert got.keys() == html.keys()
    for k, data in html.items():
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[data] == k else ("revisit", last[data]))
    stored = warc.read_archives(spark, path).filter("record_type = 'response'").agg({"payload_bytes": "sum"}).first()[0]
    assert stored == sum(map(len, last))
    C.remove_path(spark, path)


def test_warc_odd(spark):
    rows = [(1, "b", "x"), (1, "a", "x"), (1, "c", "x"), (None, "u", "y"), (None, "u", "y"), (2, None, "x" * 300000), (3, "u", None)]
    pages = spark.createDataFrame([(*r, 9, "z") for r in rows], "page_id long, url string, html string, refers_to int, kind string")
    path = C.fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    got = [tuple(r) for r in warc.resolve_records(C.materialize(warc.read_archives(spark, path), "records")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 1, "response", None), (1, 1, "revisit", 1), (1, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "revisit", None), (2, 300000, "response", None), (3, 0, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = C.fresh_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0
    C.remove_path(spark, path)


# classifiers


def test_statistics_and_rules_by_definition(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    blank = re.compile(r"[ \t-\r]+")

    def numbers(t):
        count = lambda p: len(re.findall(p, t))
        words, lines, chars = blank.split(t), t.split("\n"), max(len(t), 1)
        return {
            "log_words": np.log1p(float(len(words))), "upper": count("[A-Z]+[A-Z]") / len(words), "upper_chars": count("[A-Z]") / chars, "symbols": count(r"[#$%&*+/<=>@\\^_`{|}~]") / chars,
            "loud": count("[!?]") / chars, "digits": count("[0-9]") / chars, "stops": count("[.,;:]") / chars, "distinct_words": len(set(words)) / len(words),
            "distinct_lines": len(set(lines)) / len(lines), "word_length": chars / len(words),
        }

    rows = {r.doc_id: r for r in docs.select("doc_id", model.column(C.text_of()).alias("score")).collect()}
    for k, t in helpers.texts(docs).items():
        x = numbers(t)
        total = model.intercept + sum(w for rule, w in model.rules if all((x[name] > at) == above for name, above, at in rule.conditions))
        assert rows[k].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_toxicity_by_definition(spark):
    texts = ["Good words here", "bad words bad", "", "bad! BAD", "nothing"]
    labels = [0, 1, 0, 1, 0]
    df = spark.createDataFrame(list(zip(labels, texts, strict=True)), "label int, text string").repartition(3)
    of = lambda t: [f for w in toxicity.tokens(t) for f in toxicity.features(w)]
    want = defaultdict(int)
    for y, t in zip(labels, texts, strict=True):
        for f in set(of(t)):
            want[y, f] += 1
    assert {(r.label, bytes(r.feature)): r.n for r in toxicity.texts_with(df).collect()} == want
    vocabulary = frozenset({b"bad ", b"word", b"here "})
    counts = {bytes(r.feature): r.n for r in toxicity.counted(df.select("text"), vocabulary).collect()}
    assert counts == {b"bad ": 4, b"word": 2, b"here ": 1, toxicity.WHOLE: 9}
    seen = {(r.label, bytes(r.feature)): (r.times, r.contexts) for r in toxicity.occurrences(df, vocabulary).collect()}
    assert seen[1, b"bad "] == (4, 4) and seen[0, b"word"] == (1, 1) and seen[1, toxicity.WHOLE][0] == 5
    odds = toxicity.log_odds({b"bad ": toxicity.Seen([1, 60], [1, 80], [1, 70]), b"word": toxicity.Seen([30, 30], [40, 40], [40, 40])}, [100, 100], [1000, 1000], {b"bad ": 30, b"word": 90}, 5000)
    y, z = 70 + 0.5 + 2000 * 30 / 5000, 1 + 0.5 + 2000 * 30 / 5000
    share = 61 / 200
    assert odds.keys() == {b"bad "}
    assert odds[b"bad "][0] ** 2 == pytest.approx(2 * 60 * np.log(60 / (100 * share)) + 2 * np.log(1 / (100 * share)))
    assert odds[b"bad "][1] == pytest.approx(np.log(y / (3000 - y)) - np.log(z / (3000 - z)))
    clear = spark.createDataFrame([(60, 1), (30, 30), (3, 0), (1, 60)], "n long, m long").select(toxicity.clear(F.col("n"), F.col("m"), 100, 100).alias("x")).collect()
    assert [r.x for r in clear] == [True, False, False, False]
    model = toxicity.Model({b"bad ": (9.0, 2.0)}, 0.8, 0.01, -3.0, 1.5)
    n, found = model.passages("fine bad bad fine fine fine bad", model.token_scores())
    assert n == 7 and sorted(round(s, 6) for *_, s in found) == [5.7]
    chance = 1 - np.exp(-0.01 * 7 * np.exp(-0.8 * 5.7))
    assert model.score(model.evidence(n, [5.7])) == pytest.approx(1 / (1 + np.exp(3 + 1.5 * np.log(chance))))


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in rows.items())
    pairs = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    good = {r.doc_id for r in quality.good_documents(docs, labels).select("doc_id").collect()}
    assert good == {k for k, r in rows.items() if r.predicted}


def test_lasso_finds_the_rule():
    rng = np.random.default_rng(0)
    table = {"a": rng.random(800), "b": rng.random(800), "noise": rng.random(800)}
    y = ((table["a"] > 0.6) & (table["b"] <= 0.5)).astype(float)
    model = quality.fit_rules(table, y)
    total = np.full(800, model.intercept)
    for rule, weight in model.rules:
        total += rule.on(table) * weight
    assert ((total > 0) == (y > 0)).mean() > 0.97 and len(model.rules) < 60


def test_toxicity_held_out(spark):
    docs, labels = helpers.documents(spark, "sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in rows.items())
    pairs = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    assert sum(a for a, b in pairs if b) >= 0.85 * sum(b for _, b in pairs)


def test_segments_are_the_maximal_ones():
    def brute(values, low, high):
        sums = np.concatenate([[0], np.cumsum(values)])
        best = max(((sums[z] - sums[a], a - z, -a, a, z) for a in range(low, high) for z in range(a + 1, high + 1)), default=None)
        if not best or best[0] <= 1e-9:
            return []
        _, _, _, a, z = best
        return [*brute(values, low, a), (a, z - 1, sums[z] - sums[a]), *brute(values, z, high)]

    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        at = sorted(rng.choice(n, int(rng.integers(0, n + 1)), replace=False).tolist())
        scores = rng.normal(1, 2, len(at)).tolist()
        values = np.full(n, -0.37)
        values[at] += scores
        got = toxicity.segments(at, scores, 0.37)
        assert [(a, z) for a, z, _ in got] == [(a, z) for a, z, _ in brute(values, 0, n)]
        assert np.allclose([s for *_, s in got], [s for *_, s in brute(values, 0, n)])


def test_classifiers_without_labels(spark):
    for rows in ([], [(1, 1, 0), (2, 1, 0), (99, 0, 1)], [(3, None, None)]):
        labels = helpers.labels(spark, rows)
        for df, n in ((helpers.odd(spark), len(helpers.ROWS)), (helpers.empty(spark), 0)):
            assert quality.score_quality(df, labels).count() == n
            assert {r.predicted for r in toxicity.score_toxicity(df, labels).collect()} <= {0}


# exact copies


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, texts, keep):
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[t].append(k)
    best = max if keep == "max" else min
    want = {(k, best(groups[t]), len(groups[t]), k == best(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs.repartition(20), keep).collect()} == want


def test_exact_dedup_odd(spark):
    rows = exact_dedup.exact_dedup(helpers.odd(spark)).collect()
    assert len(rows) == len(helpers.ROWS)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    stay = exact_dedup.kept_documents(helpers.odd(spark))
    assert stay.columns == helpers.odd(spark).columns and stay.count() == len({r[1] or "" for r in helpers.ROWS})


def test_collisions_fail():
    records = np.zeros(2, exact_dedup.RUN)
    records["bytes"] = [1, 2]
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.merged(records[:1], records[1:], "max")


def test_runs_merge_in_rounds(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    keyed = docs.repartition(20).selectExpr("doc_id", "unhex(sha2(text, 256)) digest", "cast(octet_length(text) as long) n_bytes", "xxhash64(text) check")
    runs = exact_dedup.merge_rounds(exact_dedup.runs_of(keyed, 3, "max"), 20, "max")
    assert runs._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 5
    rows = runs.collect()
    assert len(rows) == len({r.bucket for r in rows}) <= 3
    found = np.concatenate([np.frombuffer(r.records, exact_dedup.RUN) for r in rows])
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[hashlib.sha256(t.encode()).digest()].append(k)
    assert {(bytes(r["digest"]).ljust(32, b"\0"), int(r["id"]), int(r["n"])) for r in found} == {(d, max(g), len(g)) for d, g in groups.items()}
    for r in rows:
        digests = np.frombuffer(r.records, exact_dedup.RUN)["digest"].tolist()
        assert digests == sorted(digests)


CLASHING = "doc_id long, text string, source string, __gone long, __digest string, __key int, k int, v string, __row int, n int, nth int, copies string"


def test_columns_that_clash(spark):
    rows = [(k, t, "s", 1, "a", 2, 3, "b", 4, 5, 6, "c") for k, t in [(1, "one two three four five six"), (2, "one two three four five six"), (3, "other"), (3, "other"), (None, None)]]
    df = spark.createDataFrame(rows, CLASHING)
    for f, n in ((exact_dedup.kept_documents, 3), (jaccard.one_of_each, 3), (mixing.mixed_documents, None)):
        got = f(df).collect()
        assert all(tuple(r)[3:] == rows[0][3:] for r in got) and f(df).columns == df.columns
        assert n is None or len(got) == n
    assert exact_dedup.exact_dedup(helpers.empty(spark)).count() == exact_dedup.kept_documents(helpers.empty(spark)).count() == 0


def test_tables_are_deleted(spark, tmp_path):
    df = helpers.odd(spark)
    before = set(C.MADE)
    for f in (exact_dedup.exact_dedup, mixing.mix, jaccard.rooted_components, substrings.remove_repeats):
        table = f(df)
        assert [x for x in C.MADE if x not in before] == [table.made_at]
        C.discard(table)
    assert set(C.MADE) == before


# mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = total - sum(most * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in sizes if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else weight[s] * free / rest for s in sizes}
        over = {s for s in sizes if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        stopped |= over


def test_mixing(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    sizes = defaultdict(int)
    for k, n in size.items():
        sizes[source[k]] += n
    want = targets(sizes)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    taken = defaultdict(int)
    for k, r in got.items():
        assert r.size == size[k] and r.source_size == sizes[source[k]] and r.target == pytest.approx(want[source[k]])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.size == 0 or abs(r.taken / r.size - r.target / r.source_size) < 1
        taken[source[k]] += r.taken
    for s in sizes:
        largest = max(size[k] for k in size if source[k] == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(13)).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_mixing_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_odd(spark):
    rows = mixing.mix(helpers.odd(spark)).collect()
    assert len(rows) == len(helpers.ROWS)
    copies = mixing.mixed_documents(helpers.odd(spark))
    assert copies.columns == helpers.odd(spark).columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in copies.select("text").collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.mix(helpers.empty(spark)).count() == mixing.mixed_documents(helpers.empty(spark)).count() == 0


# Jaccard join


def linked(texts, words=4, num=85, den=100):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    by_shingle = defaultdict(list)
    for k in sorted(sets):
        shared = defaultdict(int)
        for s in sets[k]:
            for j in by_shingle[s]:
                shared[j] += 1
            by_shingle[s].append(k)
        for j, n in shared.items():
            if den * n >= num * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((find(j), find(k)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in texts}


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    out, k = {}, 0
    for n in (3, 5, 8, 20, 60, 200, 700):
        for group in range(6):
            base = rng.choice(words, n).tolist()
            for copy in range(1 + 12 * (group % 3)):
                now = list(base)
                for _ in range(int(rng.integers(0, 1 + n // 40 + copy % 3))):
                    now[int(rng.integers(0, n))] = "x" + str(rng.integers(0, 9))
                out[k] = " ".join(now)
                k += 1
    return out


@pytest.mark.parametrize("num,den,words,block", [(85, 100, 4, 500), (80, 100, 5, 7)])
def test_jaccard_on_edited_copies(spark, num, den, words, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, jaccard.Reach(num, den, words)).collect()}
    assert got == linked(texts, words, num, den)


@pytest.mark.parametrize("copies,blocks", [(100, 100), (0, 100), (0, 1)])
def test_divided_regions_keep_all_links(spark, copies, blocks, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COPIES", copies)  # voronoi regions; pairs of blocks; signatures
    monkeypatch.setattr(jaccard, "MANY_BLOCKS", blocks)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rng, reach, sets = np.random.default_rng(8), jaccard.Reach(), {}
    for cluster in range(9):
        base = rng.integers(0, 2**63, 40 + 10 * cluster).astype("u8")
        for copy in range(10):
            h = base.copy()
            edits = int(rng.integers(0, 8))
            h[rng.integers(0, len(h), edits)] = rng.integers(0, 2**63, edits).astype("u8")
            sets[cluster * 10 + copy] = np.unique(h)
    open_ = spark.createDataFrame([(7, k, k, len(sets)) for k in sets], "region long, node long, comp long, held long")
    table = spark.createDataFrame([(k, bytearray(h.tobytes())) for k, h in sets.items()], "node long, set binary")
    regions = defaultdict(dict)
    for r in jaccard.divided(open_, table, reach, 30).collect():
        regions[r.region][r.node] = r.side
    met = set()
    for members in regions.values():
        for a, x in members.items():
            met |= {(a, b) for b, y in members.items() if a < b and (jaccard.HOME in (x, y) or x + y == jaccard.LEFT + jaccard.RIGHT)}
    both = lambda a, b: jaccard.common_size(sets[a], sets[b])
    links = {(a, b) for a in sets for b in sets if a < b and reach.links(both(a, b), len(sets[a]) + len(sets[b]) - both(a, b))}
    assert links and links <= met
    assert copies or blocks > 1 or len(met) < 0.5 * len(sets) ** 2 / 2  # clusters are apart


def test_jaccard_on_documents(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs.repartition(9)).collect()}
    assert got == linked(texts)


def test_linked_sets_meet_at_a_signature():
    rng = np.random.default_rng(11)
    for reach in (jaccard.Reach(), jaccard.Reach(80, 100, 5)):
        for n in [*range(1, 40), 60, 61, 90, 200, 1000]:
            for _ in range(12):
                x = np.unique(rng.integers(0, 2**63, n).astype("u8"))
                y = set(x.tolist())
                for _ in range(int(rng.integers(0, reach.differ(n) + 1))):
                    y.discard(next(iter(y))) if rng.random() < 0.5 and len(y) > 1 else y.add(int(rng.integers(0, 2**63)))
                y = np.array(sorted(y), "u8")
                both = jaccard.common_size(x, y)
                if reach.links(both, len(x) + len(y) - both):
                    assert set(jaccard.signatures(x, reach).tolist()) & set(jaccard.signatures(y, reach).tolist())
                rows = [jaccard.profile_of(h) for h in (x, y)]
                one, two = (jaccard.Profiles.of([r], min(map(len, rows))) for r in rows)
                assert one.differ(slice(None), two, slice(None))[0] <= len(x) + len(y) - 2 * both


def test_jaccard_odd(spark):
    rows = jaccard.jaccard_components(helpers.odd(spark)).collect()
    assert len(rows) == len(helpers.ROWS)
    assert {r.component_id for r in rows if r.doc_id == 5 or r.doc_id is None and r.n_shingles} == {5}
    kept = jaccard.one_of_each(helpers.odd(spark))
    assert kept.columns == helpers.odd(spark).columns
    assert jaccard.jaccard_components(helpers.empty(spark)).count() == 0


def test_one_of_each_decides_by_row(spark):
    words = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 200))
    a, b, c, d = (words(k) for k in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (None, c), (None, c + " end"), (None, c), (7, d), (7, d), (7, d + " end"), (8, ""), (8, ""), (None, a)]
    kept = jaccard.one_of_each(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, nth int").repartition(3)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text.removesuffix(" end")) for r in kept)
    assert got == sorted([(1, a), (2, b), (-1, c), (7, d), (8, ""), (8, "")])


# fingerprints


def test_fingerprints(docs, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in syncmers.fingerprint_neighbours(docs.repartition(7)).collect()}
    same = defaultdict(set)
    for i, k in enumerate(ids):
        t, following = texts[k], texts[ids[(i + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = rows[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == syncmers.to_text(syncmers.sketch(*syncmers.syncmers(edited.encode())))
        same[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert np.mean([r.near_edited for r in rows.values()]) > 0.5 > 0.05 > np.mean([r.near_next for r in rows.values()])


def test_syncmers_by_definition():
    rng = np.random.default_rng(2)
    for n in (0, 1, 15, 16, 17, 40, 300):
        data = rng.integers(97, 101, n).astype(np.uint8).tobytes()
        hashes, at = syncmers.syncmers(data)
        if n < syncmers.K:
            assert len(hashes) == min(n, 1)
            continue
        inner = syncmers.mixed(np.array([int.from_bytes(data[i : i + 8], "little") for i in range(n - 7)], "u8"))
        want = [i for i in range(n - syncmers.K + 1) if min(inner[i : i + 9]) in (inner[i], inner[i + 8])]
        assert at.tolist() == want
    table = syncmers.sketch(*syncmers.syncmers(b"some text that is long enough " * 9))
    assert syncmers.likeness(table, table) == 1.0
    empty = syncmers.sketch(*syncmers.syncmers(b""))
    assert syncmers.likeness(empty, empty) == 1.0 and syncmers.likeness(empty, table) == 0.0


def test_sketch_and_likeness_by_definition():
    rng = np.random.default_rng(4)
    tables = []
    for _ in range(30):
        n = int(rng.integers(1, 200))
        hashes, at = rng.integers(0, 2**63, n).astype("u8") * np.uint64(2) + rng.integers(0, 2, n).astype("u8"), rng.integers(0, 5000, n)
        best = {}
        for h, p in sorted(zip(hashes.tolist(), at.tolist(), strict=True)):
            best.setdefault(h >> 58, (h >> 20 & 0xFFFFFF, p // 16 % 65536))
        table = syncmers.sketch(hashes, at)
        assert [tuple(x) for x in table.tolist()] == [best.get(k, (-1, -1)) for k in range(64)]
        assert syncmers.to_text(table) == "".join("%06x%04x" % best[k] if k in best else "-" * 10 for k in range(64))
        tables.append(table)
    tables += [np.where(rng.random((64, 1)) < 0.6, tables[0], tables[1]), tables[0] + np.where(tables[0] >= 0, [0, 100], [0, 0])]
    for a in tables:
        for b in tables:
            some = [k for k in range(64) if a[k, 0] >= 0 or b[k, 0] >= 0]
            same = [k for k in some if a[k, 0] == b[k, 0]]
            shift = sorted((int(a[k, 1]) - int(b[k, 1]) + 32768) % 65536 for k in same)
            want = sum(1 if abs(x - shift[len(shift) // 2]) <= 64 else 0.5 for x in shift) / len(some) if some else 1.0
            assert syncmers.likeness(a, b) == pytest.approx(want)


def test_places_among_bounds(spark):
    bounds = [-5, 0, 3, 9, 10, 40, 41, 42, 50, 77, 90]
    for n in (0, 1, 2, 3, 5, 11):
        got = spark.range(-10, 100).select("id", syncmers.place_among(bounds[:n], F.col("id")).alias("at")).collect()
        assert all(r["at"] == sum(b <= r["id"] for b in bounds[:n]) for r in got)


def test_fingerprints_odd(spark):
    assert syncmers.fingerprint_neighbours(helpers.odd(spark)).count() == len(helpers.ROWS)
    assert syncmers.fingerprint_neighbours(helpers.empty(spark)).count() == 0
    one = spark.createDataFrame([(7, "a text that follows itself")], "doc_id long, text string")
    r = syncmers.fingerprint_neighbours(one).first()
    assert r.near_next == 1.0


# repeated substrings


def removed(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        data = texts[k].encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                cover[i] += 1
                cover[i + 100] -= 1
            seen.add(window)
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[k] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def shared_passages(seed=4):
    rng = np.random.default_rng(seed)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    common = [noise(n) for n in (99, 100, 101, 130, 400)]
    out = {}
    for k in range(260):
        parts = [noise(int(rng.integers(0, 150)))]
        for _ in range(int(rng.integers(0, 4))):
            p = common[int(rng.integers(0, 5))]
            cut = int(rng.integers(0, 30)) if rng.random() < 0.4 else 0
            parts += [p[cut : len(p) - cut // 2], noise(int(rng.integers(0, 90)))]
        out[k] = "".join(parts)
    return out | {300: "ab" * 400, 301: "ab" * 60, 302: "x" * 99, 303: "x" * 100, 304: "x" * 350, 305: ""}


@pytest.mark.parametrize("many", [200, 20, 2])
def test_substrings_on_shared_passages(spark, many, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", many)
    texts = shared_passages()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect()} == removed(texts)


def test_substrings_on_documents(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs.repartition(5)).collect()}
    assert got == removed(texts)


def test_deep_shallow_orders_and_measures():
    rng = np.random.default_rng(6)
    for _ in range(80):
        strings = [bytes(rng.integers(97, 99, int(rng.integers(0, 45))).astype(np.uint8)) for _ in range(int(rng.integers(1, 40)))]
        strings += strings[: int(rng.integers(0, 4))]
        for sort in (substrings.deep_shallow, lambda s: substrings.blind_trie(s, list(range(len(s))))):
            order, common = sort(strings)
            ranked = [strings[i] for i in order]
            assert sorted(order) == list(range(len(strings))) and ranked == sorted(strings)
            assert common[0] == 0 and common[1:] == [substrings.common_prefix(a, b) for a, b in zip(ranked[:-1], ranked[1:], strict=True)]


def test_substrings_odd(spark):
    rows = substrings.remove_repeats(helpers.odd(spark)).collect()
    assert len(rows) == len(helpers.ROWS)
    assert next(r for r in rows if r.doc_id == 3).n_removed == 150000 - 5
    assert substrings.remove_repeats(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("many", [200, 2])
def test_substrings_of_repeated_rows(spark, many, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", many)
    noise = lambda n: "".join(np.random.default_rng(n).choice(list("abcdefgh"), n))
    one, two, none = noise(700), noise(400), noise(500)
    rows = [(1, one), (1, one), (2, two + one[:300]), (2, two + one[:300]), (3, one), (None, none), (None, none), (4, none[:200] + two)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = removed({-1 if k is None else k: t for k, t in rows})
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect())
    assert got == sorted((k, *want[k]) for k in (-1 if k is None else k for k, _ in rows))
    assert want[1][1] == want[-1][1] == 0 and want[3][1] == 700
