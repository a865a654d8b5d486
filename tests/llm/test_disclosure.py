import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillet.llm import disclosure as P
from quillet.llm.textops import Words

SECRETS = {"EMAIL": "jane.doe+x@mail.example.com", "IP": "192.168.10.254", "CARD": "4532 0151 1283 0366", "PHONE": "+1 (743) 555-3824", "SSN": "078-05-1120", "SECRET": "6df57b16f87eabefefcafb67b433efd90636bb6b", "IBAN": "DE89 3704 0044 0532 0130 00"}


def test_entities_and_what_is_none():
    for kind, s in SECRETS.items():
        text = f"before {s} after"
        assert [(k, text[a:b]) for a, b, k in P.entity_spans(text)] == [(kind, s)]
    for s in ("in 1999 and 2024", "3.14 and 2,000,000", "version 1.2.3", "a-b_c", "12:30:45", "Licensed under CC BY-NC 4.0."):
        assert P.entity_spans(s) == []


def corpus():
    rows = []
    for i in range(40):
        rows.append((i, f"filler{i} common words are here number {i}"))
    for i in range(40, 46):
        rows.append((i, f"the zebra{i} keeper Zanzibar wrote from boss@corp.example.com about common words {i}"))
    for i in range(46, 50):
        rows.append((i, f"Zanzibar partly {i} alone here"))
    return rows


def brute(rows, min_support=P.MIN_SUPPORT):
    """(entity value, term) -> share of the entity's information."""
    docs = []
    for _, t in rows:
        spans = P.entity_spans(t)
        raw = np.frombuffer(t.encode(), np.uint8)
        w = Words(raw, np.array([0, len(raw)]))
        terms = {t[a:b].lower() for a, b in zip(w.starts, w.ends)}
        inside = {t[a:b].lower() for a, b in zip(w.starts, w.ends) if any(a < y and b > x for x, y, _ in spans)}
        docs.append((t, {t[a:b].lower() for a, b, _ in spans}, terms - inside, terms))
    n, n_e, n_t, n_et, texts = len(docs), Counter(), Counter(), Counter(), {}
    for t, es, ts, every in docs:
        n_e.update(es)
        n_t.update(every)
        for e in es:
            for x in ts:
                n_et[e, x] += 1
                texts.setdefault((e, x), set()).add(t)
    return {k: math.log(c * n / (n_e[k[0]] * n_t[k[1]])) / math.log(n / n_e[k[0]]) for k, c in n_et.items() if len(texts[k]) >= min_support}


def test_shares_like_a_loop(spark):
    rows = corpus()
    rows += rows[40:42]  # repeated rows count as documents, not as further texts
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1))
    want = sorted(round(v, 9) for v in brute(rows).values())
    got = sorted(round(r.share, 9) for r in P.disclosure_table(df).collect())
    assert got == want and len(want) > 5


def test_disclosing_terms_go_and_others_stay(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in P.sanitise(df, P.fit(df)).collect()}
    shares = {t: s for (_, t), s in brute(rows).items()}
    for i, t in rows:
        r = out[i]
        if not P.entity_spans(t):
            assert r.text == t and r.entities == r.generalised == r.removed == 0
        else:
            assert "boss" not in r.text and "[EMAIL]" in r.text and "common words" in r.text
            for term in ("keeper", "zanzibar", "about"):
                assert (term in r.text.lower()) == (shares[term] < P.GENERALISE)
            assert f"zebra{i}" in r.text  # seen in one text only: no association can be estimated
    assert any(s >= P.REMOVE for s in shares.values()) and any(P.GENERALISE <= s < P.REMOVE for s in shares.values())
    assert "[NAME]" in out[41].text and out[41].removed > 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no entity"), (4, "mail a@b.cd now"), (4, "mail a@b.cd now"), (None, "a@b.cd"), (5, "word " * 100_000 + SECRETS["IP"]), (6, " ".join(SECRETS.values()))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("entities", F.lit("x")).withColumn("id", F.lit(1))
    out = P.sanitise(df, P.fit(df)).collect()
    assert len(out) == len(rows) and sum(r.text is None for r in out) == 1
    for r in out:
        assert r.text is None or not any(s in r.text for s in [*SECRETS.values(), "a@b.cd"])
    assert [r.text for r in out if r.doc_id in (2, 3)] == ["", "no entity"]
    empty = df.limit(0)
    assert P.sanitise(empty, P.fit(empty)).count() == 0


def test_no_entity_is_left_in_the_tables(spark, small):
    df = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    changed = 0
    for r in P.sanitise(df, P.fit(df)).collect():
        assert P.entity_spans(r.text) == []
        assert r.entities or r.text == text[r.doc_id]
        changed += r.entities > 0
    assert changed > 10


def test_what_stands_beside_an_entity_of_one_or_two_texts(spark):
    """Rare terms beside an entity in fewer texts than the support disclose it; common ones don't."""
    rows = [(i, f"filler{i % 50} common words are here") for i in range(3000)]
    rows += [(3000, "common words: Quimby wrote from one@corp.example.com")]
    rows += [(3001 + i, f"common words: Xanthippe {i} wrote with lantern from two@corp.example.com and three@corp.example.com") for i in range(2)]
    rows += [(3003, "Quimbyless text: common words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in P.sanitise(df, P.fit(df)).collect()}
    n = len(rows)
    share = {k: math.log(low * n / (k * k)) / math.log(n / k) for k, low in ((1, 0.05129), (2, 0.35536))}
    assert all(P.GENERALISE <= s < P.REMOVE for s in share.values())
    assert "Quimby" not in out[3000].text and out[3000].text.startswith("common words: [NAME] ")
    for i in (3001, 3002):
        assert "Xanthippe" not in out[i].text and "lantern" not in out[i].text and "common words" in out[i].text
    assert out[3003].text == rows[-1][1] and out[0].text == rows[0][1]


FEW_FIGURES = ["AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghij" * 4, "gho_" + "a" * 36, "ghu_" + "a" * 36, "ghs_" + "a" * 36, "ghr_" + "a" * 36, "sk-" + "abcdefghij" * 2, "xoxb-" + "abcdefghijkl", "xoxa-" + "abcdefghijkl", "xoxp-" + "abcdefghijkl",
               "eyJhbGciOiJub" + ".abcdefghijkl" + ".xyz", "abcdefgh" * 4 + "7", "GB12ABCDEFGHIJKLMNOPQR", "abcd:ef:ab:cd:ef:aa:bb:cc", "٠٥٥ ١٢٣ ٤٥٦٧", "+९१२३४५६७८९", "４５３２ ０１５１ １２８３ ０３６６"]


def test_entities_of_few_ascii_figures_are_found(spark):
    rows = [(i, f"mine: {s} it is") for i, s in enumerate(FEW_FIGURES)] + [(100 + i, s) for i, s in enumerate(FEW_FIGURES)]
    out = P.Disclosures()(P.pa.array([t for _, t in rows]))
    for (_, t), new, n in zip(rows, out[0].to_pylist(), out[1][:, 0].tolist()):
        assert len(P.entity_spans(t)) == 1 == n and new == "".join([t[: P.entity_spans(t)[0][0]], f"[{P.entity_spans(t)[0][2]}]", t[P.entity_spans(t)[0][1] :]])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.entities == 1 for r in P.sanitise(df, P.fit(df)).collect())
    # every character that \d matches makes a candidate
    other = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isdecimal()]
    assert len(P._candidates(*P.flat(P.pa.array(other)))) == len(other) > 500
    assert len(P._candidates(*P.flat(P.pa.array(["plain words", "", "in 199 a task-based risk-", "a:b:c:d"])))) == 0


def test_texts_that_are_not_searched_hold_nothing(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("text").collect() if r.text]
    some = set(P._candidates(*P.flat(P.pa.array(texts))).tolist())
    assert all(i in some or not P.entity_spans(t) for i, t in enumerate(texts))


def test_many_entities_and_words_take_little_memory_and_time():
    """An archive of 20,000 addresses and 200,000 words: the work is no product of both."""
    import time
    import tracemalloc

    text = " ".join(f"user{i}@mail{i}.example.com said {' '.join(f'w{(7 * i + k) % 5000}' for k in range(10))}" for i in range(20_000))

    class Pairs:
        def find(self, keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

        def numbers(self, where):
            return np.array([int(h) & ~1 | 1 for h in Words(np.frombuffer(b"w17", np.uint8), np.array([0, 3])).hash.view(np.int64)], np.int64)

    tracemalloc.start()
    began = time.time()
    new, entities, generalised, removed = P.Disclosures(Pairs()).sanitise(text)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert entities == 20_000 and generalised == 0 and removed == text.split().count("w17") > 0 and "w17 " not in new and "w18 " in new


def test_words_in_entities_like_a_loop(spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        d = P._Document(r.text or "")
        if d.spans:
            raw = r.text.encode()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            spans = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in zip(w.starts, w.ends)]
            assert list(zip(d.start, d.stop)) == [(a, b) for a, b in spans if not any(a < y and b > x for x, y, _ in d.spans)]


def test_terms_are_generalised_on_the_tables(spark, small):
    df = spark.read.parquet(f"{small}/../sf0.1/documents.parquet")
    done = P.sanitise(df, P.fit(df)).agg(F.sum("entities").alias("e"), F.sum("generalised").alias("g"), F.sum("removed").alias("r"), F.count_if(F.col("entities") > 0).alias("n")).first()
    print(done)
    assert done.e > 500 and done.g + done.r > 500
