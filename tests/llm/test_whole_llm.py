import itertools
import random
import unicodedata
import uuid
from collections import Counter

import pandas as pd

from kinweave.llm import leaks, mojibake, queries, spellings, survivor, titles, visual
from kinweave.plans.workspace import Workspace

WORDS = {"Łódź": 9, "Zürich": 40, "Kraków": 25, "café": 3, "Müller": 12, "żółw": 1, "naïve": 1, "Жуков": 2}


def _model():
    grams = Counter()
    for w, n in {**WORDS, "Zurich": 5, "Krakow": 2, "plain": 30}.items():
        p = f"^^{w}$"
        for i in range(len(p) - 2):
            grams[p[i : i + 3]] += n
    return mojibake.Model({g: float(n) for g, n in grams.items()})


def test_margin_is_validated_on_every_word_and_every_garbled_form(spark):
    model = _model()
    below = lambda g: sum(g > m for m in mojibake.MARGINS)
    want, gains = Counter(), []
    for w, n in WORDS.items():
        gains.append((False, model.best(w, n)[1], 100 * n))
        gains += [(True, model.best(form)[1], n) for form in mojibake.garble(w)]
        want[False, below(model.best(w, n)[1])] += n
        for form in mojibake.garble(w):
            want[True, below(model.best(form)[1])] += n
    frame = pd.DataFrame({"word": list(WORDS), "n": list(WORDS.values())})
    got = next(mojibake._tally(model)(iter([frame])))
    assert {(g, k): n for g, k, n in got.itertuples(index=False, name=None)} == dict(want)
    wrong = lambda m: sum(n for garbled, g, n in gains if (g <= m) == garbled)
    clean = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    assert mojibake.validated_margin(clean.repartition(3), model) == min(mojibake.MARGINS, key=lambda m: (wrong(m), m))
    assert mojibake.validated_margin(clean.limit(0), model) == 3.0


def test_every_name_field_in_consistent_form(spark, tables, tmp_path):
    wide, cyr = "Ａdam", "Ѕоѕ"
    part = {"value": wide, "value_latin": cyr, "reading": wide}
    persons = [
        {"row_id": 1, "identity": {"name": {"display": wide, "display_latin": cyr, "reading": wide, "components": [{"value": "x"}, part]}, "names": [{"display": "a"}, {"display": cyr, "components": [part]}]}},
        {"row_id": 2}, {"row_id": 3, "identity": {"names": [None, {"display": wide}]}},
    ]
    tables("persons", persons).write.parquet(f"{tmp_path}/persons.parquet")
    got = sorted(tuple(r) for r in queries.p5_names(spark, str(tmp_path)).collect())
    assert got == sorted([
        (1, "display", 0, wide, "Adam"), (1, "name.display_latin", 0, cyr, "Sos"), (1, "name.reading", 0, wide, "Adam"),
        (1, "value", 0, "x", "x"), (1, "value", 1, wide, "Adam"), (1, "value_latin", 1, cyr, "Sos"), (1, "reading", 1, wide, "Adam"),
        (1, "names", 0, "a", "a"), (1, "names", 1, cyr, cyr), (1, "names[1].value", 0, wide, "Adam"),
        (1, "names[1].value_latin", 0, cyr, "Sos"), (1, "names[1].reading", 0, wide, "Adam"), (3, "names", 1, wide, "Adam"),
    ])


def test_every_code_point_has_one_form():
    _, mapping, _, _ = visual._tables()
    for o in range(0x80, 0x110000):
        ch = chr(o)
        if unicodedata.category(ch) not in ("Cn", "Cs", "Co"):
            want = visual._plain(ch)
            assert mapping.get(ch, ch) == want or unicodedata.combining(ch), hex(o)
    for text, want in (("\u845b\U000e0100", "\u845b"), ("a\U000e0041b", "ab"), ("\U0002f800", "\u4e3d"), ("Geor\u0261e", "George")):
        assert visual.consistent(text) == want


def test_given_names_are_assigned_at_least_cost():
    nick = spellings.Nicknames([])
    name = lambda *given: (given, "penford")
    assert spellings.same_name(name("anna", "m", "maria"), name("anna", "maria", "magda"), nick) is not None
    assert spellings.same_name(name("karl", "j", "john"), name("karl", "john", "james"), nick) is not None
    assert spellings.same_name(name("anna", "ruth", "maria"), name("anna", "maria", "magda"), nick) is None
    rng = random.Random(6)
    for _ in range(300):
        n, m = sorted((rng.randint(1, 4), rng.randint(1, 5)))
        cost = [[rng.choice([None, 0.0, 0.5, 1.0, 1.7]) for _ in range(m)] for _ in range(n)]
        sums = [sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n) if all(cost[i][j] is not None for i, j in enumerate(p))]
        got = spellings.assigned(cost)
        assert (got is None) == (not sums) and (not sums or abs(got - min(sums)) < 1e-9)


def test_first_names_that_can_be_one_share_a_key():
    nick, rng = spellings.Nicknames([("william", "bill")]), random.Random(8)
    for _ in range(4000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(min(3, len(b)))
            b[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [b[k], "x"]])
            if not b:
                break
        b = "".join(b)
        if len(b) > 1 and spellings.token_cost(a, b, None) is not None:
            assert set(spellings.first_keys(a, nick)) & set(spellings.first_keys(b, nick)), (a, b)
    assert set(spellings.first_keys("wilhelm", nick)) & set(spellings.first_keys("vvilhelm", nick))


def test_hot_bundle_of_one_family_name(spark, tables):
    # a third of all people in one bundle under one family name: only those of one year and first letters meet
    first = "Thomas Gerard Philip Edmund Barnaby Quentin Lucius Victor Samson Hector Magnus Isidor".split()
    people = [{"row_id": i, "id": f"p{i:04d}", "bundle_id": "hot", "identity": {"name": {"display": f"{first[i % 12]} Oakley"}}, "birth": {"date": {"value": str(1500 + i // 4 * 2)}}} for i in range(600)]
    got = spellings.variant_pairs(tables("persons", people))
    assert got.count() == 0
    people += [{"row_id": 1000, "id": "x", "bundle_id": "hot", "identity": {"name": {"display": people[5]["identity"]["name"]["display"]}}, "birth": people[5]["birth"]}]
    assert [tuple(r) for r in spellings.variant_pairs(tables("persons", people)).collect()] == [("p0005", "x")]


def _shuffled(spark):
    """Bytes written to shuffles so far, all stages together."""
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def test_people_meet_as_numbers(spark, tables):
    # most people have nobody to meet: neither their keys nor their names may go about more than once
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).title()
    key = lambda: str(uuid.UUID(int=rng.getrandbits(128)))
    bundles, families = [key() for _ in range(20)], [word(8) for _ in range(400)]
    people = [
        {"row_id": i, "id": key(), "bundle_id": rng.choice(bundles), "identity": {"name": {"display": f"{word(6)} {word(5)} {rng.choice(families)}"}}, "birth": {"date": {"value": str(rng.randint(1500, 1999))}}}
        for i in range(4000)
    ]
    twin = {**people[7], "row_id": 4000, "id": "twin"}
    before = _shuffled(spark)
    got = [tuple(sorted(r)) for r in spellings.variant_pairs(tables("persons", [*people, twin])).collect()]
    assert tuple(sorted((people[7]["id"], "twin"))) in got
    assert (_shuffled(spark) - before) / len(people) < 600  # measured: 207; 1,643 when whole rows met


def test_families_of_a_place_meet_by_their_keys(spark):
    # more families in a bundle and year than are compared with each other: the keys lose no pair
    rng = random.Random(10)
    tokens = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(600)}
    few, many = sorted(tokens)[: spellings.FEW], sorted(tokens)
    df = spark.createDataFrame([(1, t) for t in many] + [(2, t) for t in few], "place long, family string")
    got = {(r.place, r.family, o) for r in spellings.neighbours(df).collect() for o in r.others}
    assert got == {(p, a, b) for p, ts in ((1, many), (2, few)) for a, b in itertools.combinations(ts, 2) if spellings._near(a, b)}


def test_passage_in_many_pieces(spark, tables):
    words = [f"word{i}" for i in range(40)]
    items = tables("eval_items", [{"item_id": 1, "text": " ".join(words)}])
    pieces = [" ".join(words[k : k + 7]) for k in (0, 7, 14, 21)]
    loose = [" ".join(words[k : k + 4]) for k in (0, 12, 24, 34, 6)]
    docs = {1: " other talk of no item ".join(pieces), 2: " other talk ".join(loose), 3: " and so on ".join(pieces[:2]), 4: " x ".join(reversed(pieces))}
    table = tables("documents", [{"doc_id": k, "text": t} for k, t in docs.items()])
    assert {r.doc_id for r in leaks.leaks(table, items).collect()} == {1}
    spans = leaks.removal_spans(table, items).orderBy("first_word").collect()
    assert [(r.first_word, r.end_word) for r in spans] == [(0, 7), (12, 19), (24, 31), (36, 43)]


def test_titles_of_many_words(spark, tables):
    ref = tables("title_reference", [{"title_code": "9", "title": "inspector of weights and measures", "lang": "en"}])
    occ = tables("occupations", [{"id": "a", "title": "Inspector of weights and measures, Holwick 1850"}, {"id": "b", "title": " "}, {"id": "c", "title": "juggler"}])
    assert sorted(tuple(r) for r in titles.occupation_codes(occ, ref).collect()) == [("a", "9"), ("c", "NONE")]
    assert [tuple(r) for r in titles.unmatched(occ, ref).collect()] == [("juggler", 1)]


def test_trigram_table_within_its_bound(spark):
    words = spark.createDataFrame([(w, n) for w, n in WORDS.items()] + [("plain", 30)], "word string, n long")
    ws = Workspace(spark, "test")
    whole, small = mojibake.trained(ws, words), mojibake.trained(ws, words, 25)
    assert whole.alphabet is None and len(whole.three) > 25 >= len(small.three)
    assert set("".join(small.three)) <= small.alphabet | {mojibake.POOLED}
    rare = next(c for w in WORDS for c in w if c not in small.alphabet)
    assert small.score(rare) == small.score(mojibake.POOLED) != whole.score(rare)


def test_agreement_of_rule_and_model(spark, tables):
    said = lambda i, k, source, value: {"row_id": i, "id": f"p{k}", "created_by": source, "birth": {"date": {"value": value}, "confidence": 0.9 if source == "a" else 0.1}}
    rows = [said(10 * k + j, k, s, "1900" if s != "c" else str(1800 + k)) for k in range(20) for j, s in enumerate("abc")]
    got = [tuple(r) for r in survivor.agreement(tables("persons", rows)).collect()]
    assert got == [("birth_date", 20, 20)]
    assert survivor.agreement(tables("persons")).count() == 0
