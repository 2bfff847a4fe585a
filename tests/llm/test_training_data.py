"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "the end"
#: Nulls in every column, empty and very long texts, repeated rows and ids, texts in other scripts.
ODD = [
    (1, "Released under the MIT License.\nPlain words stand here, and a few more of them.", "en", "a", 5),
    (2, "Released under the MIT License.\nPlain words stand here, and a few more of them.", "en", "a", 5),
    (2, "Released under the MIT License.\nPlain words stand here, and a few more of them.", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", "a", None),
    (None, "Licensed under CC BY-NC 4.0.", "en", None, 1),
    (None, None, "en", "c", 1),
    (7, "Élan naïve ÜBER 日本語 <|im_end|> \x00 tab\tand\x0bmore", "fr", "c", 1),
    (8, "cc by nc cc by nc cc by nc", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("keep_id", F.lit("x")).withColumn("row_key", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("words", F.lit("w")).withColumn("fp", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# components


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_graphs(spark, seed):
    from quillsift.llm.components import connected_components

    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = components(300, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: want[x] for x in touched}


def test_no_links_no_components(spark):
    from quillsift.llm.components import connected_components

    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: licenses


def base_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = [(k, label) for phrase, label in phrases.items() for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(k for k, _ in found), ",".join(sorted({label for _, label in found}))


def test_license_base_places(spark, texts):
    from quillsift.llm.licenses import op1_license_scans

    for row in op1_license_scans(spark, SF).collect():
        n, places, labels = base_places(texts[row["doc_id"]])
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (n, len(places), labels)
        assert (row["first_word"], row["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert set(filter(None, labels.split(","))) <= set(filter(None, row["labels"].split(","))) and 0 <= row["score"] <= 1


def test_license_odd_rows(spark, odd):
    from quillsift.llm.licenses import scan_licenses

    rows = scan_licenses(odd).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        if row["doc_id"] == 8:
            assert sorted(s["start"] for s in row["spans"] if s["base"]) == [0, 3, 6]
        if row["doc_id"] == 7:
            assert row["spans"] == []
        if row["doc_id"] is None and row["n_words"]:
            assert {s["label"] for s in row["spans"]} == {"cc-by-nc"}
    assert scan_licenses(odd.limit(0)).count() == 0


def test_license_notice_with_inserted_word(spark):
    from quillsift.llm.licenses import scan_licenses

    text = "Redistribution and use in source and binary forms, with or without further modification, are permitted provided that the following conditions are met"
    row = scan_licenses(spark.createDataFrame([(1, "clean " + text), (2, "redistribution of plain words in forms")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [s["label"] for s in row[0]["spans"]] == ["bsd"] and row[0]["spans"][0]["start"] == 1 and row[1]["spans"] == []


def best_span(words, notice, slack):
    """Largest share of the notice's grams on diagonals as far apart as the drift allows, by trying every first diagonal."""
    grams, drift = [notice[k : k + 3] for k in range(len(notice) - 2)], max(slack, (len(notice) - 2) // 8)
    held = [(k - at, at) for k in range(len(words) - 2) for at, g in enumerate(grams) if words[k : k + 3] == g]
    return max((len({at for d, at in held if start <= d <= start + drift}) / len(grams) for start, _ in held), default=0.0)


def test_license_labels_against_every_diagonal(spark, texts):
    from quillsift.llm.licenses import NOTICES, scan_licenses

    rng, rows = random.Random(7), list(texts.values())[:60]
    for notice, _ in NOTICES:
        for edits in (0, 1, 2, 3, 5):
            words = notice.split()
            for _ in range(edits):
                k = rng.randrange(len(words))
                words[k : k + rng.choice((0, 0, 1))] = rng.choice((["really"], ["as", "such"], []))
            rows.append(" ".join([*["before"] * rng.randrange(4), *words, "after", *words[::-1], *words[len(words) // 2 :], *words[: len(words) // 2]]))
    found = scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for row in found:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in rows[row["doc_id"]] or ""))
        shares = [(label, best_span(words, notice.split(), 2)) for notice, label in NOTICES]
        assert {s["label"] for s in row["spans"] if not s["base"]} == {label for label, share in shares if share >= 0.8}
        kept = [share for _, share in shares if share >= 0.8]
        assert max((s["coverage"] for s in row["spans"] if not s["base"]), default=0.0) == pytest.approx(max(kept, default=0.0))
    assert len(found) == len(rows) and sum(bool(r["spans"]) for r in found) > 20


def test_license_long_template_and_drift(spark):
    from quillsift.llm.licenses import scan_licenses

    words = [f"w{k}" for k in range(400)]
    long = " ".join(words)
    put_in = " ".join(w + (" new" if k % 40 == 20 else "") for k, w in enumerate(words))
    halves = " ".join(words[200:] + words[:200])
    short = [f"v{k}" for k in range(32)]
    drifting = " ".join(w + (" x y" if k % 6 == 5 else "") for k, w in enumerate(short))
    docs = spark.createDataFrame([(1, long), (2, put_in), (3, halves), (4, drifting), (5, f"{long} and {long}")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in scan_licenses(docs, notices=((long, "long"), (" ".join(short), "short")), coverage=0.6).collect()}
    assert [s["coverage"] for s in found[1]] == [1.0] and [s["start"] for s in found[5]] == [0, 401]
    assert [s["coverage"] for s in found[2]] == [pytest.approx((398 - 20) / 398)]
    assert found[3] == [] and found[4] == []


# 2: quality


def test_quality_on_held_out_labels(spark):
    from quillsift.llm.quality import op2_quality_classifier

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op2_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.99


def test_estimated_prior_of_the_documents(spark):
    """The query's prior comes from positives and unlabelled texts; the share of positives among the labelled is near it, though no label 0 was learnt from."""
    from quillsift.llm.quality import train

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    share = labels.where("quality IS NOT NULL").agg(F.avg("quality")).first()[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prior = train(docs, labels).prior
    assert abs(prior - share) < 0.15
    assert train(docs, labels.where("quality = 1")).prior == pytest.approx(prior, abs=0.1)  # without labels 0 these texts count as unlabelled


def test_quality_odd_rows(spark, odd):
    from quillsift.llm.quality import classify, keep_good

    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert classify(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert keep_good(odd, labels.limit(0)).columns == odd.columns and keep_good(odd, labels.limit(0)).count() == len(ODD)


def test_prior_from_positives_and_unlabelled():
    from quillsift.llm.quality import estimated_prior

    rng = np.random.default_rng(3)
    positive, mixed = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 2400), rng.normal(-3, 1, 1600)])
    assert abs(estimated_prior(positive, mixed) - 0.6) < 0.05


# 3: simhash


def brute_fingerprints(texts):
    import xxhash

    out = []
    for text in texts:
        words = text.encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    return out


def test_simhash_against_all_pairs(spark, texts):
    from quillsift.llm.simhash import op3_simhash_near_dedup

    ids = sorted(texts)
    prints = brute_fingerprints([texts[i] for i in ids])
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(len(ids), links)
    rows = {r["doc_id"]: r for r in op3_simhash_near_dedup(spark, SF).collect()}
    assert len(links) > 5 and len(rows) == len(ids)
    assert all(rows[i]["fingerprint"] == f"{p:016x}" and rows[i]["component_id"] == ids[c] for i, p, c in zip(ids, prints, want, strict=True))


@pytest.mark.parametrize(("home", "visitors"), [(4096, 65536), (3, 5)])
def test_fingerprint_links_join_what_all_pairs_join(spark, home, visitors):
    """Also when the tiles are so full that they are cut into many units."""
    from quillsift.llm.components import connected_components
    from quillsift.llm.simhash import fingerprint_links

    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:25]:
        for _ in range(8):
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted((v - (1 << 64) if v >> 63 else v) for v in values | {0, 1, 3, (1 << 64) - 1})
    links = [(a, b) for a in range(len(values)) for b in range(a) if ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count() <= 3]
    want = components(len(values), links)
    found = connected_components(fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, home, visitors))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert [got.get(v, v) for v in values] == [values[c] for c in want]


def test_simhash_odd_rows(spark, odd):
    from quillsift.llm.simhash import drop_near_duplicates, simhash_components

    rows = simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert got[(3, "0" * 16)] == got[(4, "0" * 16)] == got[(None, "0" * 16)] == 3
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert simhash_components(odd.limit(0)).count() == 0 and drop_near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_near_duplicates_go_by_a_fixed_order(spark, monkeypatch, most):
    from quillsift.llm import simhash

    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    same, other = "one text that several rows hold word for word", "nothing here is like the other text at all"
    rows = [(4, same, "b"), (4, same, "a"), (4, same, "a"), (9, same, "a"), (None, same, "c"), (7, other, "x"), (7, other, "x")]
    found = [simhash.drop_near_duplicates(spark.createDataFrame(r, "doc_id long, text string, source string")).collect() for r in (rows, rows[::-1])]
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1])) and sorted(r["doc_id"] for r in found[0]) == [4, 7]


# 4: token counts


def test_length_histogram_against_brute_force(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillsift.llm import lengths

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counted = sorted(len(model.encode(t, add_special_tokens=False).ids) for t in texts.values())
    rows = lengths.op4_token_counts(spark, SF).collect()
    assert [r["length"] for r in sorted(rows)] == sorted(set(counted))
    for r in rows:
        n = r["length"]
        assert r["n_docs"] == counted.count(n)
        assert (r["docs_at_least"], r["tokens_at_least"]) == (sum(x >= n for x in counted), sum(x for x in counted if x >= n))
        assert (r["docs_upto"], r["tokens_upto"]) == (sum(x <= n for x in counted), sum(x for x in counted if x <= n))
        assert r["truncated_tokens"] == sum(min(x, n) for x in counted)
    table = lengths.histogram(spark.createDataFrame([(x,) for x in counted], "length int"))
    assert tuple(lengths.totals(table).first()) == (len(counted), sum(counted), max(counted))
    assert {r["share"]: r["length"] for r in lengths.quantiles(table, (0.5, 0.9, 1.0)).collect()} == {q: counted[int(np.ceil(q * len(counted))) - 1] for q in (0.5, 0.9, 1.0)}
    limits = (1, 100, 1000, 10**6)
    got = {r["context_limit"]: (r["kept_tokens"], r["cut_docs"]) for r in lengths.limits_table(table, limits).collect()}
    assert got == {m: (sum(min(x, m) for x in counted), sum(x > m for x in counted)) for m in limits}


def test_length_odd_rows(spark, odd):
    from quillsift.llm import lengths

    found = lengths.encoded_lengths(odd.withColumn("length", F.lit(9)))
    assert found.count() == len(ODD) and {r["length"] for r in found.where("doc_id in (3, 4)").collect()} == {0}
    empty = lengths.histogram(found.limit(0))
    assert empty.count() == 0 and tuple(lengths.totals(empty).first()) == (0, 0, None)
    assert lengths.quantiles(empty).count() == 0 and {r["kept_tokens"] for r in lengths.limits_table(empty).collect()} == {0}


# 5: chat


def test_chat_round_trip(spark):
    from quillsift.llm.chat import op5_chat_formatting, probe

    turns = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(probe(spark)).orderBy("turn").collect()
    talks = {}
    for t in turns:
        talks.setdefault(t["conv_id"], []).append((t["role"], t["text"] or ""))
    rows = {r["conv_id"]: r for r in op5_chat_formatting(spark, SF).collect()}
    assert rows.keys() == talks.keys()
    for conv, talk in talks.items():
        said = "".join(text for role, text in talk if role == "assistant")
        assert rows[conv]["n_turns"] == len(talk)
        assert rows[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in talk).encode()).hexdigest()
        assert (rows[conv]["loss_chars"], rows[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_examples_and_odd_rows(spark):
    from quillsift.llm.chat import format_conversations, read_turns

    odd_turns = [
        (1, 0, "user", "a <| b <\\| c <|im_start|>"), (1, 1, "assistant", "x<|im_end|>\n"), (1, 2, "assistant", None), (1, 3, None, "tail"), (1, 3, None, "tail"),
        (2, 0, "us\ner", ""), (None, 0, "user", "lone"), (None, 0, "assistant", "lone"), (3, None, "assistant", "no turn"),
    ]
    turns = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string").withColumn("lone", F.lit(1)).withColumn("formatted", F.lit("x"))
    made = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))).orderBy("conv_id", "lone", "example").collect()
    first = [r for r in made if r["conv_id"] == 1]
    assert [len(r["turns"]) for r in first] == [2, 3, 5] and [r["loss_length"] is None for r in first] == [False, False, True]
    assert [tuple(t) for t in first[-1]["turns"]] == [(a or "", b or "") for _, _, a, b in odd_turns[:5]]
    assert [tuple(t) for r in made if r["conv_id"] == 2 for t in r["turns"]] == [("us\ner", "")]
    assert sorted(len(r["turns"]) for r in made if r["conv_id"] is None) == [1, 1]
    assert format_conversations(turns.limit(0)).count() == 0


# 6: URLs


def test_url_rules_and_parts(spark):
    from quillsift.llm.urls import filter_urls

    cases = {
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://example.com/en/6": ("example.com", "/en/6", "com/en/", "block"),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "ftp://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://a.org?/es/": ("a.org", "", None, None),
        "http://a.org/es/\n?x://b": ("a.org", "/es/\n", "org/es/", "block"),
        "no scheme": ("", "", None, None),
        "http://free-casino-bets.example.org/fr/1": ("free-casino-bets.example.org", "/fr/1", None, "block"),
        "http://www.thering.example.org/fr/1": ("www.thering.example.org", "/fr/1", None, "allow"),
    }
    rows = [(k, u) for k, u in enumerate(cases)] + [(None, None), (99, None), (99, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("spam", F.lit(1))
    found = filter_urls(pages).collect()
    assert len(found) == len(rows) and {r["verdict"] for r in found} <= {"allow", "block"}
    for k, want in enumerate(cases.values()):
        row = next(r for r in found if r["page_id"] == k)
        assert (row["host"], row["path"], row["rule"]) == want[:3] and want[3] in (None, row["verdict"])
    assert all((r["host"], r["path"]) == ("", "") for r in found if r["page_id"] in (None, 99))
    assert filter_urls(pages.limit(0)).count() == 0


def test_url_regression_on_held_out_urls(spark):
    """Four fifths of the labelled URLs judge the rest; words that no labelled URL holds are not claimed to be known."""
    from quillsift.llm import urls

    rows = urls.LABELLED
    assert len(rows) == len({r[:2] for r in rows}) > 500
    for fold in range(5):
        weight, offset = urls.train(tuple(r for k, r in enumerate(rows) if k % 5 != fold))
        right = [(urls.probability(h, p, weight, offset) >= 0.5) == bool(y) for k, (h, p, y) in enumerate(rows) if k % 5 == fold]
        assert np.mean(right) >= 0.9
    hosts = {r["host"] for sf in ("sf0.001", "sf0.01") for r in urls.op6_url_filters(spark, f"/root/testdata/{sf}").select("host").collect()}
    assert not hosts & {h for h, _, _ in rows}


def test_url_query_against_brute_force(spark):
    from quillsift.llm import urls

    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    weight, offset = urls.train()
    found = {r["page_id"]: r for r in urls.op6_url_filters(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert len(found) == len(pages)
    for page in pages:
        head, mark, rest = (page["url"] or "").partition("://")
        host = re.split("[/?#]", rest)[0] if mark else ""
        path = re.split("[?#]", rest[len(host) :])[0] if mark else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(d + s), d + s, v) for d, s, v in rules if (host == d or host.endswith("." + d)) and path.startswith(s)]
        verdict = max(fits)[2] if fits else "block" if urls.probability(host, path, weight, offset) >= 0.5 else "allow"
        row = found[page["page_id"]]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, max(fits)[1] if fits else None, verdict)


# 7: packing


def test_packing_pieces_and_places(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillsift.llm.packing import op7_best_fit_packing

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op7_best_fit_packing(spark, SF).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sorted(pieces[doc]) == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_tokenizer_takes_short_cuts_only_where_they_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillsift.llm.packing import tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    encode, rng = tokenizer(), random.Random(5)
    signs = "abzAZ09 '.,!\"-_|<>\n\t\r\x0b\x1c\xa0éÉßİıſŉ\u0301\u2028日本Σςσ😀²½ª"
    cases = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["don't 's 'Ll x's <|endoftext|> A.B.C ...", "ΟΔΟΣ"]
    assert all(encode(c).tolist() == model.encode(c, add_special_tokens=False).ids for c in cases)


def test_special_tokens_in_texts_as_the_tokenizer_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillsift.llm.lengths import encoded_lengths
    from quillsift.llm.packing import pack, tokenizer

    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|>Hello <|EndOfText|>", "<|endoftext", "plain words"]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in want[0]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["ids"] for r in sorted(pack(table, keep_ids=True).collect())] == [[*ids, 0] for ids in want]
    assert [r["length"] for r in sorted(encoded_lengths(table).collect())] == [len(ids) for ids in want]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):  # a tokenizer that the short cuts don't fit goes the whole way
        other = Tokenizer.from_file(public_tokenizers.path(name))
        encode = tokenizer(name, special_tokens=True)
        assert all(encode(t).tolist() == other.encode(t, add_special_tokens=False).ids for t in [*texts, "Hello World", "It's\n2 lines"])


def test_packing_odd_rows(spark, odd):
    from quillsift.llm.packing import pack

    rows = pack(odd, keep_ids=True, group=3).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    assert all(r["ids"] == [0] for r in rows if r["doc_id"] in (3, 4))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pack(odd.limit(0)).count() == 0


def test_sum_of_squares_needs_few_sequences():
    from quillsift.llm.packing import place

    lengths = np.random.default_rng(0).integers(1, 1200, 3000)
    sequence, offset = place(lengths, 2048)
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) + 2
    assert np.bincount(sequence, lengths).max() <= 2048 and (offset >= 0).all()
    assert place(np.array([2048, 2048]), 2048)[1].tolist() == [0, 0]


# 8: sketches


def paragraphs(text):
    return {line[k : k + 512] for line in text.split("\n") for k in range(0, len(line), 512)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_sets(spark, texts):
    from quillsift.llm.sketches import op8_document_fingerprints

    ids, same = sorted(texts), {}
    rows = {r["doc_id"]: r for r in op8_document_fingerprints(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for k, doc in enumerate(ids):
        text, other, row = texts[doc], texts[ids[(k + 1) % len(ids)]], rows[doc]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row["near_edited"] == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert row["near_next"] == pytest.approx(jaccard(paragraphs(text), paragraphs(other)))
        assert same.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (paragraphs(text) == paragraphs(edited))


def test_next_text_over_many_buckets(spark, monkeypatch):
    from quillsift.llm import sketches

    monkeypatch.setattr(sketches, "BUCKET", 7)
    rng = random.Random(1)
    rows = [(i, f"t{i}") for i in rng.sample(range(1000), 200)] + [(500_000, "b"), (500_000, "a"), (None, "null")]
    found = {(r["id"], r["text"]): r["next"] for r in sketches.with_next(spark.createDataFrame(rows, "id long, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}


def test_peeling_recovers_and_retries(spark):
    from quillsift.llm.sketches import difference

    rng = random.Random(2)
    pool = [rng.getrandbits(63) for _ in range(400)]
    rows = [(rng.sample(pool, a), rng.sample(pool, b)) for a, b in ((0, 0), (1, 0), (40, 40), (300, 310), (3, 200))]
    table = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for sizes, load in ((((8, 18), (24, 30), (96, 45), (400, 60)), 10), (((2, 3), (400, 60)), 60)):
        for row in table.withColumn("d", difference(F.col("a"), F.col("b"), sizes, load)).collect():
            assert sorted(tuple(x) for x in row["d"]) == sorted([(x, 1) for x in set(row["a"]) - set(row["b"])] + [(x, -1) for x in set(row["b"]) - set(row["a"])])


def test_fingerprints_odd_rows(spark, odd):
    from quillsift.llm.sketches import compare_versions

    rows = compare_versions(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    alone = compare_versions(odd.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert compare_versions(odd.limit(0)).count() == 0


def parts(text):
    from quillsift.llm.sketches import PARTS

    return set(re.findall(PARTS, text))


def test_parts_within_lines_against_sets(spark, texts):
    from quillsift.llm.sketches import op8_document_fingerprints

    ids, kept = sorted(texts), 0
    rows = {r["doc_id"]: r for r in op8_document_fingerprints(spark, SF).collect()}
    for k, doc in enumerate(ids):
        text, other, row = texts[doc], texts[ids[(k + 1) % len(ids)]], rows[doc]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert row["parts_edited"] == pytest.approx(jaccard(parts(text), parts(edited)))
        assert row["parts_next"] == pytest.approx(jaccard(parts(text), parts(other)))
        assert row["n_changed_parts"] == len(parts(text) ^ parts(edited))
        kept += row["near_edited"] == 0 < row["parts_edited"]
    assert kept > 0


def test_untouched_halves_of_single_lines_share_parts(spark):
    from quillsift.llm.sketches import PARTS, compare_versions, digests

    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choices("abcdefghinorst", k=rng.randint(2, 9))) for _ in range(n))
    texts = [line(n) for n in (30, 60, 120, 400, 2000)] + ["".join(rng.choices("0123456789abcdef", k=900))]
    rows = compare_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["parts_edited"] > 0.15 and r["parts_next"] < 0.05 for r in rows)
    pairs = spark.createDataFrame([(t, t[:5] + "~" + t[5:]) for t in texts[3:]], "a string, b string").select(digests(F.col("a"), PARTS).alias("a"), digests(F.col("b"), PARTS).alias("b")).collect()
    assert all(jaccard(set(r["a"]), set(r["b"])) > 0.5 for r in pairs)


def test_fingerprints_of_a_text_of_many_lines(spark):
    """Work grows in proportion to the lines: 20,000 of them take seconds, 40,000 not much more than twice that."""
    import time

    from quillsift.llm.sketches import compare_versions

    took = []
    for n in (20_000, 40_000):
        lines = [f"line {k} of {n}" for k in range(n)]
        texts = ["\n".join(lines), "\n".join([*lines[: n // 2], "new", *lines[n // 2 :]])]
        began = time.time()
        rows = compare_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
        took.append(time.time() - began)
        for k, row in enumerate(rows):
            text, other = texts[k], texts[1 - k]
            edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            assert row["near_next"] == pytest.approx(n / (n + 1)) and row["near_edited"] == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
            assert row["n_changed"] == len(paragraphs(text) ^ paragraphs(edited))
    assert took[1] < 60 and took[1] < 3 * took[0]


def test_fingerprints_whose_peeling_fails_are_sketched_again(spark, docs, monkeypatch):
    from quillsift.llm import sketches

    columns = ("doc_id", "n_changed", "near_edited", "near_next", "parts_edited", "parts_next", "n_changed_parts", "edited_sha256")
    some = docs.where("doc_id < 40")
    want = sorted(sketches.compare_versions(some).select(*columns).collect())
    monkeypatch.setattr(sketches, "CELLS", 1)
    monkeypatch.setattr(sketches, "ROUNDS", 2)
    opened = sketches.compared(sketches.with_next(some.selectExpr("doc_id AS id", "text")), 1, 2)
    assert opened.where("edited_short_open > 0 or next_short_open > 0").count() > 5
    assert sorted(sketches.compare_versions(some).select(*columns).collect()) == want


def shuffled(spark, job):
    """Bytes that job's stages write for other stages."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = max(stages(), default=(-1, 0))
    job()
    return sum(n for stage, n in stages().items() if stage > before)


def test_texts_are_shuffled_once_also_where_peeling_fails(spark, docs, odd, monkeypatch):
    from quillsift.llm import sketches

    some, every = docs.select("doc_id", "text"), lambda: sorted(sketches.compare_versions(odd).drop("fingerprint", "edited_fingerprint").collect(), key=str)  # another number of cells, other fingerprints
    want, joins = every(), "spark.sql.requireAllClusterKeysForCoPartition"
    monkeypatch.setattr(sketches, "CELLS", 1)
    monkeypatch.setattr(sketches, "ROUNDS", 2)
    rows = sketches.with_next(some.selectExpr("doc_id AS id", "coalesce(text, '') AS text"))
    once = shuffled(spark, lambda: rows.select("id", "text", "next").collect())
    before = spark.conf.get(joins)
    assert once > 100_000 and shuffled(spark, lambda: sketches.compare_versions(some).collect()) < 1.3 * once
    assert spark.conf.get(joins) == before and every() == want


def test_difference_ends_exactly_where_no_sketch_peels(spark):
    from quillsift.llm.sketches import difference

    rng = random.Random(6)
    rows = [([rng.getrandbits(63) for _ in range(90)], [rng.getrandbits(63) for _ in range(50)]), ([0, -(1 << 63), 5], [0]), ([], [])]
    for load in (4, 1000):
        found = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").withColumn("d", difference(F.col("a"), F.col("b"), ((2, 2),), load)).collect()
        for row in found:
            assert sorted(tuple(x) for x in row["d"]) == sorted([(x, 1) for x in set(row["a"]) - set(row["b"])] + [(x, -1) for x in set(row["b"]) - set(row["a"])])


def test_kept_sketches_are_compared_without_texts(spark, docs, tmp_path):
    from quillsift.llm.sketches import compare_sketches, sketches

    old = docs.select("doc_id", "text")
    new = old.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\none more line of this text\nand another"))).when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("text")))
    for name, table in (("old", old), ("new", new)):
        sketches(table).write.parquet(f"{tmp_path}/{name}")
    found = {r["doc_id"]: r for r in compare_sketches(spark.read.parquet(f"{tmp_path}/old"), spark.read.parquet(f"{tmp_path}/new")).collect()}
    a, b = ({r["doc_id"]: r["text"] or "" for r in t.collect()} for t in (old, new))
    assert found.keys() == a.keys()
    for doc, row in found.items():
        if row["done"]:
            assert (row["only_old"], row["only_new"]) == (len(parts(a[doc]) - parts(b[doc])), len(parts(b[doc]) - parts(a[doc])))
    assert sum(not r["done"] for r in found.values()) <= 1  # a text that is gone leaves all of its digests in a sketch of one size


def test_next_text_of_repeated_null_and_string_ids(spark, monkeypatch):
    from quillsift.llm import sketches

    monkeypatch.setattr(sketches, "BUCKET", 5)
    rows = [(None, f"{k:03d}") for k in range(60)] + [("a", f"{k:03d}") for k in range(60)] + [("b", "x"), ("b", "x"), ("b", "x"), ("c", None)]
    table = spark.createDataFrame(rows, "id string, text string").withColumn("text", F.coalesce("text", F.lit("")))
    dealt = sketches.with_next(table)
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want = sorted(((i or "", t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)))
    found = dealt.collect()
    assert sorted((r["id"] or "", r["text"], r["next"]) for r in found) == want
    assert max(sum(r["bucket"] == b and r["id"] is None for r in found) for b in {r["bucket"] for r in found}) < 40
    assert sketches.compare_versions(table, "id").count() == len(rows)


# 9: vectors


def test_vectors_against_all_pairs(spark):
    from quillsift.llm.hyperplanes import near_duplicate_vectors

    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [(int(100 + k), [float(x) for x in base[k % 30] + rng.normal(scale=0.06 * (k % 3), size=16)], int(k % 30 % 3)) for k in range(300)]
    rows += [(k, rows[0][1], rows[0][2]) for k in range(5)] + [(7, rows[0][1], None), (8, None, 0), (9, [0.0] * 16, 0), (10, [float("nan")] * 16, 0), (11, [], 0), (12, [None] * 16, 0), (13, [float("inf")] + [1.0] * 15, 0), (14, [1.0], 0)]
    rows += [(None, rows[0][1], rows[0][2]), (100, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("hash", F.lit(1)).withColumn("component", F.lit("c"))
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.98]
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    label = components(len(rows), links)
    smallest = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    want = sorted((str(rows[k][0]), int(n[k]), str(smallest[label[k]]), rows[k][0] is not None and rows[k][0] == smallest[label[k]]) for k in range(len(rows)))
    for side in (2048, 4):
        found = near_duplicate_vectors(table, side=side, tables=24, bits=8).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found) == want
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_vector_recall(spark):
    """Pairs just above the threshold are found; the documented chance to miss one is below a ten-thousandth."""
    from quillsift.llm.hyperplanes import near_duplicate_vectors

    rng = np.random.default_rng(9)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.concatenate([a, 0.981 * a + np.sqrt(1 - 0.981**2) * b])
    found = near_duplicate_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(pairs)], "vec_id long, embedding array<double>, label int"))
    assert found.where("n_links > 0").count() >= 0.999 * 2000


# 10: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), min(1.5 * sum(sizes.values()), 2 * sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(1e-300, sum(weight[s] for s in free))
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def check_mix(rows, texts, most_error):
    sizes, taken, target = {}, {}, {}
    for r, (text, source) in zip(rows, texts, strict=True):
        n = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        assert r["size"] == n and r["taken"] in (0, n, 2 * n)
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = (r["target"], r["source_size"])
    want = brute_targets(sizes)
    for source, n in sizes.items():
        assert target[source][1] == n and target[source][0] == pytest.approx(want[source])
        assert abs(taken[source] - want[source]) <= most_error


def test_mixing_targets_and_reruns(spark, docs):
    from quillsift.llm.mixing import mix

    known = docs.orderBy("doc_id").collect()
    rows = mix(docs).orderBy("doc_id").collect()
    longest = max(r["size"] for r in rows)
    check_mix(rows, [(r["text"], r["source"]) for r in known], longest / 2)
    again = mix(docs.repartition(7)).orderBy("doc_id").collect()
    assert rows == again


def test_mixing_odd_rows(spark, odd):
    from quillsift.llm.mixing import mix, mixed

    rows = mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0
    assert mix(odd.limit(0)).count() == 0 and mixed(odd.limit(0)).count() == 0
    twice = mixed(odd)
    assert twice.columns == odd.columns
    counts = {}
    for r in twice.collect():
        counts[(r["doc_id"], r["text"])] = counts.get((r["doc_id"], r["text"]), 0) + 1
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r["doc_id"] and len(re.findall("[^\x20\x09-\x0d]+", t or "")) == r["size"])
        copies = sum(1 for i, t, *_ in ODD if (i, t) == (r["doc_id"], text))
        assert not r["size"] or counts.get((r["doc_id"], text), 0) == copies * r["taken"] // r["size"]


def test_mixing_takes_repeated_rows_by_number(spark, tmp_path):
    from quillsift.llm.mixing import mix, mixed

    rows = [(1, "w " * 100, "a")] * 1000 + [(k, "w " * 10, "b") for k in range(1000)] + [(5, "w " * 7, None)] * 30 + [(None, None, "a")] * 3
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    found = mix(table).collect()
    sums = {}
    for r in found:
        key = r["source_size"]
        sums[key] = (sums.get(key, (0, 0))[0] + r["taken"], r["target"])
    assert len(found) == len(rows) and len(sums) == 3
    assert all(abs(taken - target) <= 50 for taken, target in sums.values())
    copies = {r["source"]: r["n"] for r in mixed(table).groupBy("source").agg(F.sum(F.size(F.split(F.rtrim("text"), " "))).alias("n")).collect()}
    assert copies["a"] == sums[100_000][0] and copies["b"] == sums[10_000][0]


def test_mixing_with_more_sources_than_are_broadcast(spark, monkeypatch):
    from quillsift.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 30), None if k % 11 == 0 else f"s{k % 40:02d}") for k in range(2000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id").collect()
    check_mix(found, [(t, s) for _, t, s in rows], 15)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 4
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == counts[3]
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(run) == key(packed)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
