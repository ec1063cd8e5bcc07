import random
import unicodedata
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from kinweave.llm import abuse, leaks, mojibake, spellings, survivor, titles, tokens, visual

T = [datetime(2025, m, 1) for m in range(1, 13)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def human(display, birth, pid, bundle="b", row_id=1, aliases=None, latin=None, sex=None, parts=None, **more):
    name = {"display": display, "display_latin": latin, "components": parts or []}
    return {"row_id": row_id, "id": pid, "bundle_id": bundle, "identity": {"name": name, "names": aliases, "gender": {"value": sex}}, "birth": {"date": {"value": birth}}, **more}


# ---- problem 5


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ａｎｎａ　Ｍ．", "Anna M."), ("Schäf", "Schäf"), ("a​b c­", "ab c"), ("Аlехаndеr Crangate", "Alexander Crangate"),
        ("Мария Волкова", "Мария Волкова"), ("Гoрдев", "Гордев"), ("ｶﾞｲ", "ガイ"), ("ﬁn", "fin"), ("Τhomаѕ", "Thomas"), ("", ""), ("Zoë 波多坂", "Zoë 波多坂"),
        ("e‍́", "é"), ("Gόrnewskι", "Górnewski"),
    ],
)
def test_consistent(text, want):
    assert visual.consistent(text) == unicodedata.normalize("NFC", want)
    assert visual.consistent(want) == want


def test_latin_field_and_idempotence():
    assert visual.consistent("Ѕоѕ", latin_field=True) == "Sos" and visual.consistent("Ѕоѕ") == "Ѕоѕ"
    rng = random.Random(1)
    pool = "aé́​ＡｶﾞＯОоßﬁ  　漢νж"
    for _ in range(2000):
        t = visual.consistent("".join(rng.choice(pool) for _ in range(rng.randint(0, 8))))
        assert visual.consistent(t) == t


def test_affected_fields(spark, tables, clash):
    persons = tables("persons", [
        human("Ａnna", "1900", "p", row_id=1, aliases=[{"display": "x y"}, {"display": None}, None], parts=[{"value_latin": "Аnna", "reading": "ﾊﾅ"}]),
        human("Anna", "1900", "p", row_id=2), {"row_id": 3}, human(None, None, None, row_id=4), human("é" * 100_000 + "é", "1", "l", row_id=5),
    ])
    want = [(1, "display"), (1, "names"), (1, "reading"), (1, "value_latin"), (5, "display")]
    assert rows(visual.affected_fields(clash(persons, "value", "v", "latin", "field_name", "normal"))) == want
    assert visual.affected_fields(tables("persons")).count() == 0


# ---- problem 4


def test_survivors(spark, tables, clash):
    def row(i, pid, birth=None, conf=None, at=None, names=None):
        return {"row_id": i, "id": pid, "updated_at": at, "created_by": "a", "birth": {"date": {"value": birth}, "confidence": conf}, "identity": {"names": names}}

    persons = tables("persons", [
        row(1, "p", "1900", None, "2020-01-01T00:00:00+02:00"), row(2, "p", "1900-01", 0.5, "2020-01-01T00:00:00Z"), row(3, "p", "1900-02", 0.5, "2020-01-01T01:00:00+02:00"),
        row(4, "p", None, 0.9, "2021", [{"display": "a"}, {"display": "a"}, {"display": None}]), row(5, "p", None, None, None, [{"display": "a"}]),
        row(6, "one", "1900"), row(7, None, "1900"), row(8, None, "1900"), row(9, "tie", "1", 1.0, "x"), row(10, "tie", "1", 1.0, "x"), row(11, "bare"), row(12, "bare", None, None, None, []),
    ])
    got = rows(survivor.survivors(clash(persons, "n", "at", "best", "field_name")))
    assert got == [("p", "birth_date", 2), ("p", "names", 4), ("tie", "birth_date", 9)]
    assert survivor.survivors(tables("persons")).count() == 0
    values, sources = survivor.latent_truth(persons)
    assert {r.value for r in values.where("id = 'p' and kept and field_name = 'birth_date'").collect()} <= {"1900", "1900-01", "1900-02"}
    assert sources.where("sensitivity <= 0 or sensitivity >= 1 or specificity <= 0 or specificity >= 1").count() == 0


def test_latent_truth_prefers_the_reliable_source(spark, tables):
    rng, data, i = random.Random(3), [], 0
    for k in range(60):
        for source, good in (("sure", 0.95), ("fair", 0.8), ("poor", 0.3)):
            i += 1
            value = "1900" if rng.random() < good else str(1800 + rng.randrange(90))
            data.append({"row_id": i, "id": f"p{k}", "created_by": source, "birth": {"date": {"value": value}}})
    values, sources = survivor.latent_truth(tables("persons", data))
    q = {r.source: r.sensitivity for r in sources.where("field_name = 'birth_date'").collect()}
    assert q["sure"] > q["fair"] > q["poor"]
    assert values.where("kept and value = '1900'").count() >= 54


# ---- problem 8


def test_tokens_equal_the_library_and_decode(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(5)
    pool = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "a", "É", "12", "!", "　", "日", "<|endoftext|>", "́", "😀", "\x85", "x" * 70]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 15))) for _ in range(3000)] + ["", "a" * 50_000 + "!" * 50_000, "it's 'tis ''s I'm we'll  'lla"]
    docs = tables("documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": -1}])
    got = tokens.encode_table(docs.withColumn("ids", docs.lang), with_offsets=True)
    for r in got.collect():
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids
        assert (r.ends[-1] if r.ends else 0) == len(text.encode())
    back = {r.doc_id: r.text for r in tokens.decode_table(got).collect()}
    assert all(back[i] == t for i, t in enumerate(texts)) and back[-1] == ""
    assert tokens.encode_table(tables("documents")).count() == 0


# ---- problem 7


@pytest.fixture(scope="module")
def reference():
    listed = [("1", "blacksmith", "en"), ("1", "forgeron", "fr"), ("1", "kowal", "pl"), ("2", "baker", "en"), ("2", "Bäcker", "de"), ("2", "boulanger", "fr"), ("3", "agricultural labourer", "en"), ("4", "basket maker", "en"), ("5", "ship's carpenter", "en"), ("6", "carpenter", "en"), ("7", "miller", "en"), ("7", "Müller", "de")]
    return titles.Reference(listed)


@pytest.mark.parametrize(
    "title, code",
    [
        ("Blacksmith", "1"), ("b1acksmith", "1"), ("blacksrnith", "1"), ("kwoal", "1"), ("former blacksmith employing 3 men", "1"), ("Bäckerin", "2"), ("baecker", "2"), ("boulangère", "2"),
        ("ag lab", "3"), ("agric. labr", "3"), ("maker, basket", "4"), ("basket-maker", "4"), ("carpenter, ship's", "5"), ("carp.", "6"), ("carpr", "6"), ("muller", "7"), ("mueller", "7"),
        ("astronomer royal", "NONE"), ("illegible", "NONE"), ("retired", "NONE"), ("???", "NONE"), ("", "NONE"), ("x" * 5000, "NONE"), ("dancing bear leader", "NONE"),
    ],
)
def test_titles(reference, title, code):
    assert reference.code_of(title) == code


def test_trie_search_equals_brute_force(reference):
    def plain(a, b):
        return spellings.distance(a, b, 9)

    rng = random.Random(2)
    forms = list(reference.exact)
    for _ in range(300):
        w = list(rng.choice(forms))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcekrs")
        w = "".join(w)
        want = {}
        for f in forms:
            if (x := plain(w, f)) <= 2:
                for c in reference.exact[f]:
                    want[c] = min(x, want.get(c, 9))
        assert reference.within(w, 2) == want


def test_occupation_codes(spark, tables, clash):
    ref = tables("title_reference", [{"title_code": "1", "title": "baker", "lang": "en"}, {"title_code": None, "title": "x"}, {"title_code": "2", "title": None}])
    occ = tables("occupations", [{"id": "a", "title": "baker", "ingested_at": T[0]}, {"id": "a", "title": "astronaut", "ingested_at": T[1]}, {"id": "b", "title": "  "}, {"id": "c"}, {"id": "d", "title": "BAKER."}])
    assert rows(titles.occupation_codes(clash(occ, "title_code", "occupation_id"), clash(ref, "code"))) == [("a", "NONE"), ("d", "1")]
    assert rows(titles.occupation_codes(occ, tables("title_reference"))) == [("a", "NONE"), ("d", "NONE")]
    assert titles.occupation_codes(tables("occupations"), ref).count() == 0


# ---- problem 2


def gedcom(values, file="f", **more):
    out, n = [], 0
    for v in values:
        n += 1
        tag, value = v if isinstance(v, tuple) else ("NOTE", v)
        out.append({"file_id": file, "line_no": n, "level": 1, "tag": tag, "value": value, "ingested_at": T[0]} | more)
    return out


def test_garbled_records(spark, tables, clash):
    clean = ["Sa sœur aînée épousa René à Noël", "Hinterließ fünf Söhne und drei Töchter", "Zmarła na gorączkę, służba później", "Метрическая книга сгорела", "35 m² ±3 °C JOÃO"] * 40
    broken = ["épousa René".encode().decode("cp1252"), "Söhne und Töchter".encode("cp1252").decode("cp850"), "gorączkę".encode("iso8859-2").decode("latin-1"), "Метрическая".encode("koi8-r").decode("cp1251"), "G�rn�w"]
    split = "fünf Söhne".encode().decode("latin-1")
    lines = gedcom(clean + [None, ""], "a") + gedcom(broken, "b") + gedcom([("CONC", "lost é")] + [("NOTE", split[:2]), ("CONC", split[2:]), ("CONT", "plain"), ("NOTE", None)], "c")
    lines += gedcom(["Söhne"], "b", ingested_at=T[1], line_no=2)  # a reload puts this line right
    table = clash(tables("gedcom_lines", lines), "block", "head", "n", "word", "repeat", "odd")
    found = {(r.file_id, r.line_no): r.restored for r in mojibake.garbled_records(table).collect()}
    assert set(found) == {("b", 1), ("b", 3), ("b", 4), ("b", 5), ("c", 2)}
    assert found["b", 1] == "épousa René" and found["b", 3] == "gorączkę" and found["b", 4] == "Метрическая" and found["c", 2] == "fünf Söhne\nplain"
    assert mojibake.garbled_records(tables("gedcom_lines")).count() == 0


def test_records_across_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(mojibake, "BLOCK", 3)
    lines = gedcom([("NOTE", "a"), *[("CONC", f"é{i}") for i in range(20)], ("NOTE", "b"), ("CONT", "ü")])
    got = rows(mojibake.records(tables("gedcom_lines", lines + lines)))
    assert got == [("f", 1, "a" + "".join(f"é{i}" for i in range(20))), ("f", 22, "b\nü")]


# ---- problem 3


def test_variant_pairs(spark, tables, clash):
    nick = [{"kind": "nickname", "display": "Tommy Penford"}]
    people = [
        human("Thomas Penford", "1850-03-01", "t1", aliases=nick), human("Thomas Kelgate", "1700", "t9", aliases=[{"kind": "nickname", "display": "Tommy Kelgate"}]), human("Penford, Tommy", "1850", "t2"),
        human("T. Pnford", "1851", "t3"), human("Rev. Thomas Penford", "1849-12-30", "t4"), human("Thomas Penford", "1853", "no"), human("Thomas Penford", "1850", "far", bundle="c"),
        human("Mary Eleanor Oakley", "1800", "m1"), human("Mary Oakley", "1800", "m2"), human("Eleanor Oakley", "1800", "m3"),
        human("Мария Волкова", "1900", "v1"), human("VOLKOVA Mariya", "1900", "v2", latin="Mariya Volkova"), human("Marja Volkova", "1900", "v3", sex="F"), human("Marja Volkova", "1900", "v4", sex="M"),
        human("霧島田 静", "1920", "k1", parts=[{"kind": "given_name", "value": "静", "value_latin": "Shizu"}, {"kind": "family_name", "value": "霧島田", "value_latin": "Kirishimada"}]), human("Kirishimaad, Shizu", "1920", "k2"), human("霧島田 静", "1920", "k3"),
        human(None, "1850", "n1"), human("Thomas Penford", None, "n2"), human("", "1850", "n3"), human("x", "abcd", "n4"), human("Thomas Penford", "1850", None), human("Thomas Penford", "1850", "n5", bundle=None), {"row_id": 9},
    ]
    people += people[:3]
    got = set(rows(spellings.variant_pairs(clash(tables("persons", people), "year", "family", "given", "k", "letter", "bucket"))))
    assert {("t1", "t2"), ("t1", "t3"), ("t1", "t4"), ("t2", "t4"), ("m1", "m2"), ("v1", "v2"), ("k1", "k2"), ("k1", "k3"), ("k2", "k3")} <= got
    assert not {p for p in got if "no" in p or "far" in p or "n5" in p or "t9" in p} and ("m1", "m3") not in got and ("m2", "m3") not in got and ("v3", "v4") not in got
    assert all(a < b for a, b in got)
    assert spellings.variant_pairs(tables("persons")).count() == 0


def test_delete_keys_find_every_small_distance(spark):
    rng, pairs = random.Random(7), []
    for _ in range(400):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randint(5, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [rng.choice("abcdef")], [b[k], "x"]])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", spellings._delete_keys(df.a).alias("x"), spellings._delete_keys(df.b).alias("y")).collect():
        if len(r.b) >= 5 and spellings.distance(r.a, r.b, 2) <= 2:
            assert set(r.x) & set(r.y), (r.a, r.b)


# ---- problem 9

ITEM = "In 1416 the nameless archive near Graulice was pledged by Richard Whitsey, a quartermaster, because of the closing of the canal. Susannah Thorngate swore, with Eleanor Stanstone as witness, that three bad harvests ruined the schoolmistress."


def test_fm_index_equals_brute_force():
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 40):
        text = np.concatenate((rng.integers(1, alphabet, 700), [0]))
        index = leaks.FMIndex(text, alphabet)
        phrases = rng.integers(1, alphabet, (60, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark, tables, clash):
    w = ITEM.split()
    changed = [*w]
    changed[7], changed[16] = "Xyz", "zyx"
    docs = {
        1: "before " + " ".join(w[3:26]) + " after", 2: " ".join(w[:12]), 3: ITEM.upper().replace(" ", "\n"), 4: " ".join(changed), 5: "<b>" + ITEM.replace(" ", "</b> <i>") + "</i>",
        6: " ".join(w[:14]) + " something else altogether comes between here and there " + " ".join(w[20:34]), 7: None, 8: "", 9: " \n", 10: "other words " * 30_000 + ITEM, 11: "In 1500 the old archive near Berwick was pledged by John Penley, a tailor, because of the closing of the shop.",
        12: ITEM.replace("a", "а").replace(" ", " "),
    }
    items = tables("eval_items", [{"item_id": 1, "text": ITEM}, {"item_id": 1, "text": ITEM}, {"item_id": 2, "text": None}, {"item_id": 3, "text": "too short"}, {"item_id": None, "text": ITEM}])
    table = clash(tables("documents", [{"doc_id": k, "text": t} for k, t in docs.items()] + [{"doc_id": 1, "text": docs[1]}, {"doc_id": None, "text": ITEM}]), "item_id", "n_words")
    assert {r.doc_id for r in leaks.leaks(table, items).collect()} == {1, 3, 4, 5, 6, 10, 12}
    spans = rows(leaks.removal_spans(table.where("doc_id = 1"), items))
    assert spans == [(1, 1, 24)]
    assert leaks.leaks(tables("documents"), items).count() == 0 and leaks.leaks(table, tables("eval_items")).count() == 0


# ---- problem 10


def test_disguises():
    for text in ("you fucking moron", "yov f.u.c.king m_o_r_o_n", "y0u fuck1ng m0r0n", "you fuuuucking moroooon", "you f**king m*ron", "YOU FUCKING MORON.!1!"):
        x = dict(zip(abuse.FEATURES, abuse.features(text, abuse.Lexicon()), strict=True))
        assert x["top_insult"] >= 1 and x["top_swearing"] >= 1 and x["top_second"] >= 1, text
    for text in ("The cat sat on the mat in 1850", None, " \n ", "", "you " * 50):
        assert abuse.features(text, abuse.Lexicon()) is None
    for text in ("Eres un cabrón y un gilipollas", "Sei uno stronzo", "Ты мудак"):
        assert abuse.features(abuse.unicodedata.normalize("NFC", text), abuse.Lexicon()) is not None or text.startswith("Ты")


def test_words_near_hits_are_learned():
    sober = [[["bastard", "son", "of", "the"]], [["bastard", "son", "in", "the"]]] * 20
    harsh = [[["you", "bastard"], ["bastard", "son"]], [["you", "bitch"]]] * 20
    weights = abuse.word_weights([(w, 0.0, 1.0) for w in sober] + [(w, 1.0, 1.0) for w in harsh])
    assert weights["you"] > 1 and weights["son"] < 0 and abuse.context(harsh[0], weights) > 0 > abuse.context(sober[0], weights)
    assert abuse.word_weights([]) == {} and abuse.context([], weights) == 0


def test_words_of_offending_texts_are_learned(spark):
    rows_ = [(f"text {i} " + ("gribble" if i % 3 == 0 else "calm"), float(i % 3 == 0), 1.0, i % 5) for i in range(60)]
    judged = spark.createDataFrame(rows_, "text string, y double, w double, fold int")
    assert abuse.learned_words(judged) == [frozenset({"gribble"})] * 6


def test_isotonic_equals_definition():
    rng = np.random.default_rng(1)
    s, y, w = rng.random(60), rng.random(60), rng.integers(1, 4, 60).astype(float)
    xs, ys = abuse.isotonic(s, y, w)
    fit = np.interp(np.sort(s), xs, ys)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * w[np.argsort(s)]).sum() - (y * w).sum()) < 1e-6


def test_held_out_accuracy_and_edges(spark, tables, clash):
    rng = random.Random(4)
    bad = ["You are a filthy moron and your family is shit.", "Shut your mouth, you stupid bitch.", "Free porn, nude pics, xxx cam girls, horny singles.", "Never trust refugees, they are vermin and parasites, hang them.", "Espèce de connard, ferme ta gueule."]
    good = ["The bastard son of Mary was recognised in the register.", "The census lists a prostitute at Berwick.", "The hangman was ordered to kill every stray bitch and hog in the lanes.", "The farm passed to a nephew.", "Le cochon fut vendu au curé."]
    docs, labels, truth = [], [], {}
    for i in range(600):
        truth[i] = i % 4 == 0
        parts = [rng.choice(good) for _ in range(rng.randint(1, 5))]
        if truth[i]:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(bad))
        docs.append({"doc_id": i, "source": "s" if i % 2 else None, "text": " ".join(parts)})
        if i < 300:
            labels += [{"doc_id": i, "reviewer": r, "is_abusive": truth[i] != (rng.random() < 0.08)} for r in "ab"]
    docs += [{"doc_id": 1000, "text": None}, {"doc_id": 1001, "text": ""}, {"doc_id": 1002, "text": " \n"}]
    labels += [{"doc_id": None, "is_abusive": True}, {"doc_id": 5, "is_abusive": None}, {"doc_id": 9999, "is_abusive": True}]
    d, l = clash(tables("documents", docs), "score", "x", "y", "w"), clash(tables("review_labels", labels), "text", "y")
    got = {r.doc_id: r.is_abusive for r in abuse.scored(d, l).collect()}
    held = [i for i in truth if i >= 300]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.95
    assert not (got[1000] or got[1001] or got[1002])
    assert abuse.rates(d, l).count() == 2
    assert abuse.offending(d, tables("review_labels")).count() == 0 and abuse.offending(tables("documents"), l).count() == 0


def test_pandas_batches_of_no_rows():
    assert list(visual._normalise(iter([pd.DataFrame({"row_id": [], "field_name": [], "latin": [], "value": []})])))[0].empty
