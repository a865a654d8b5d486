import random
import re

from pyspark.sql import functions as F

from quillet.llm import decontaminate as D

ITEMS = [
    (1, "Ann has 3 kg of apples and Bob gives her 5 more kg, so how many kg of apples does Ann have now in the basket?"),
    (2, "The quick brown fox jumps over the lazy dog while the old cat sleeps under a warm red blanket today."),
    (3, "What is the capital of the country where Maria and John met in 1987 after they left the town of Lima?"),
    (4, "tiny little item here"),
    (5, "no"),
    (6, None),
]
OLD, NEW = ["3", "5", "Bob"], ["40", "2.5", "Tom"]


def reworded():
    """Item 1 with other names and numbers, each always by the same."""
    t = ITEMS[0][1].replace("so how", "so how")
    return t.replace(" 3 ", " 40 ").replace(" 5 ", " 2.5 ").replace("Bob", "Tom").replace("does Ann", "does Eve")


def run(spark, docs, items=ITEMS, **kwargs):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(0))
    return {(r.doc_id, r.item_id): r for r in D.matches(d, b, **kwargs).collect()}


def test_exact_reworded_and_inconsistent(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do magna".split()) for _ in range(n))
    inconsistent = ITEMS[2][1].replace("Maria", "Paul").replace("in 1987", "in 2001")
    docs = [
        (10, f"{noise(30)}. {ITEMS[1][1]} {noise(30)}"),
        (11, f"{noise(30)} {reworded()} {noise(9)}"),
        (12, ITEMS[1][1].upper()),
        (13, noise(500)),
        (14, f"{noise(5)}. {inconsistent}"),
        (15, None),
        (16, ""),
        (None, ITEMS[1][1]),
        (17, "a tiny little item here too"),
        (18, "x " * 50_000 + ITEMS[1][1]),
        (10, f"{noise(3)} {ITEMS[1][1]}"),
        (19, "The quick brown fox jumps over a fence and runs away from the noisy farm before the sun comes up again."),
    ]
    got = run(spark, docs)
    assert {k for k in got} == {(10, 2), (11, 1), (12, 2), (14, 3), (17, 4), (18, 2)}
    assert got[11, 1].changed and got[14, 3].changed and not got[10, 2].changed
    left = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 13, 15, 16, 19]


def test_slots_must_be_consistent(spark):
    item = "start with 4 red balls then add 4 blue balls and take 4 green balls away from the old box"
    same = item.replace("4", "9")
    mixed = "start with 9 red balls then add 8 blue balls and take 7 green balls away from the old box"
    joined = "start with 9 red balls then add 5 blue balls"
    got = run(spark, [(1, same), (2, mixed), (3, joined)], [(1, item)])
    assert got[1, 1].changed and got[1, 1].covered == got[1, 1].item_tokens
    assert (2, 1) not in got and (3, 1) not in got


def test_empty_tables(spark):
    assert run(spark, [(1, ITEMS[1][1])], ITEMS[:0] or [(6, None)]) == {}
    d = spark.createDataFrame([], "doc_id long, text string")
    assert D.matches(d, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def naive_tokens(text):
    """(template token, value) by regular expressions."""
    numbers, units, out, last = set(D.NUMBERS.split()), set(D.UNITS.split()), [], 0
    for m in re.finditer(r"[0-9A-Za-zÀ-῿]+", text):
        w, gap, first = m.group(), text[last : m.start()], not out and last == 0
        last = m.end()
        opens = first or re.search(r"[.!?:\n]", gap) is not None
        kind = "NUM" if w.isdigit() and w.isascii() or w.lower() in numbers else "UNIT" if w.lower() in units else None
        if kind is None and not opens and w[0].isupper() and len(w) > 1 and (w[1].islower() or not w[1].isascii() and not w[1].isupper()):
            kind = "NAME"
        if kind in ("NUM", "NAME") and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + w.lower())
        else:
            out.append((kind or w.lower(), w.lower() if kind else None))
    return out


def naive(docs, items, window=D.WINDOW):
    out = {}
    items = {i: naive_tokens(t) for i, t in items}
    for d, text in docs:
        doc = naive_tokens(text)
        index = {}
        for i in range(len(doc) - window + 1):
            index.setdefault(tuple(t for t, _ in doc[i : i + window]), []).append(i)
        for item, tokens in items.items():
            covered, lines = set(), {}
            for j in range(len(tokens) - window + 1):
                key = tuple(t for t, _ in tokens[j : j + window])
                if sum(v is None for _, v in tokens[j : j + window]) < D.MIN_WORDS * window:
                    continue
                for i in index.get(key, []):
                    lines.setdefault(i - j, []).append(j)
            for shift, js in lines.items():
                pairs = {(tokens[k][1], doc[k + shift][1]) for j in js for k in range(j, j + window) if tokens[k][1] is not None}
                sound = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                for j in js:
                    if sound or all(v is None for _, v in tokens[j : j + window]):
                        covered |= set(range(j, j + window))
            if covered and len(covered) >= min(D.MIN_COVER, -(-len(tokens) // 2)):
                out[d, item] = len(covered)
    return out


def test_like_a_loop_on_the_tables(spark, small):
    d, b = (spark.read.parquet(f"{small}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.covered for r in D.matches(d, b).collect()}
    want = naive([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert got == want and want


def test_items_of_numbers_and_short_ones_match_verbatim(spark):
    """Windows with few words and items of few tokens count where words and values are the same."""
    dense = "Train A: 60 km 2 hours, 90 km 3 hours, 120 km 4 hours."
    items = [(1, dense), (2, "What is 12 + 7?"), (3, "5 kg 7 kg 9 lb"), (4, "no"), (5, "prime 7")]
    docs = [(1, f"one more. {dense} That was it"), (2, dense.replace("60", "61").replace("90", "91").replace("120", "121")), (3, "so, what is 12 + 7? tell me"), (4, "what is 12 + 8?"), (5, "take 5 kg 7 kg 9 lb of it"), (6, "no"), (7, "there is no way"), (8, "a prime 7 it is"), (9, "the prime 5")]
    got = run(spark, docs, items)
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 4), (8, 5)}
    assert not any(r.changed for r in got.values()) and all(r.covered == r.item_tokens for r in got.values())


def test_numbers_and_units_of_four_languages(spark):
    items = [
        (1, "Der alte Bauer fährt heute zwölf Kilometer und braucht dafür drei Stunden auf dem nassen Weg zu Hof und Feld"),
        (2, "le vieux fermier marche douze kilomètres et il lui faut trois heures pour rentrer par la route humide"),
        (3, "el viejo campesino camina doce kilómetros y necesita tres horas para volver por el camino mojado"),
    ]
    docs = [
        (1, items[0][1].replace("zwölf", "zwanzig").replace("drei", "fünf")),
        (2, items[1][1].replace("douze", "vingt").replace("trois", "7")),
        (3, items[2][1].replace("doce", "15").replace("tres", "cuatro")),
        (4, "el viejo campesino canta y luego duerme"),
    ]
    got = run(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and all(r.changed for r in got.values())


def test_columns_of_any_name_stay(spark):
    d = spark.createDataFrame([(1, ITEMS[1][1]), (2, "clean text"), (None, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__gone", "gone", "item_id", "hash")})
    left = D.drop_contaminated(d, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]


def test_sql_matches_dense_windows_and_short_items_too(spark, tmp_path):
    """The SQL and the operator agree on verbatim windows."""
    import duckdb

    from quillet.llm import queries as Q

    dense = "Train A: 60 km 2 hours, 90 km 3 hours, 120 km 4 hours."
    items = [*ITEMS, (7, dense), (8, "What is 12 + 7?"), (9, "5 kg 7 kg 9 lb"), (10, "prime 7")]
    docs = [(1, f"one more. {dense} That was it"), (2, dense.replace("60", "61").replace("90", "91")), (3, "so, what is 12 + 7? tell me"), (4, "what is 12 + 8?"), (5, "take 5 kg 7 kg 9 lb of it"), (6, "no"), (7, "there is no way"), (8, "a prime 7 it is"), (9, reworded()), (10, "a tiny little item here"), (11, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(Q.OP9_SQL).fetchall())
    got = sorted(tuple(r) for r in Q.op9_decontaminate(spark, str(tmp_path)).collect())
    assert got == want and {(d, i) for d, i, *_ in got} == {(1, 7), (3, 8), (5, 9), (6, 5), (8, 10), (9, 1), (10, 4)}
