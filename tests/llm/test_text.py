"""The text operators against plain versions and hand-made cases."""

import random
import textwrap

import numpy as np
import pytest

from lumbung.llm import leakage, packing, quality, tokens

KINDS = ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- tokens ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", KINDS)
def test_counts_of_every_kind(name):
    path = f"/opt/tokenizers/{name}"
    texts = ["hello world", "", None, "a" * 30, "obat — stok"]
    got = tokens.count_tokens(texts, path)
    assert got[1] == got[2] == 0 and got[0] in (2, 3) and all(n > 0 for n in (got[0], got[3], got[4]))


def test_two_files_of_one_vocabulary_agree():
    texts = ["Stock of 12 vials.\r\n\r\n  Next!", "<|endoftext|> x", "don't   stop"]
    assert tokens.count_tokens(texts, f"/opt/tokenizers/{KINDS[0]}") == tokens.count_tokens(texts, f"/opt/tokenizers/{KINDS[1]}")


def test_long_texts_are_counted_in_parts(monkeypatch):
    assert list(tokens.parts("aa  bb\n\ncc dd", 1)) == ["aa", "  bb", "\n\ncc", " dd"] and list(tokens.parts("x" * 250, 100)) == ["x" * 250]
    r = random.Random(3)
    pieces = ["word", "it's", "12", "…", " ", "  ", "\n", "\t \n", "é中", "--", "'", "\u00a0", "\u3000", "Stok", "🙂", "\r\n"]
    for _ in range(60):
        text = "".join(r.choice(pieces) for _ in range(400))
        whole = tokens.count_tokens([text])
        for size in (1, 7, 100):
            assert "".join(tokens.parts(text, size)) == text
            monkeypatch.setattr(tokens, "PART_CHARS", size)
            assert tokens.count_tokens([text]) == whole
        monkeypatch.undo()
    for name in KINDS[1:]:
        text = " ".join(f"word{i}" for i in range(3000))
        whole = tokens.count_tokens([text], f"/opt/tokenizers/{name}")
        monkeypatch.setattr(tokens, "PART_CHARS", 50)
        assert tokens.count_tokens([text], f"/opt/tokenizers/{name}") == whole
        monkeypatch.undo()
    with pytest.raises(ValueError):
        tokens.count_tokens(["x"], "vocabulary.txt")


# --- packing ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    sizes = np.concatenate([r.integers(1, 400, 400), r.integers(300, 1001, 60), [0, 0, 1000]])
    bins = packing.pack(sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 1000 for b in bins)
    assert len(bins) <= int(np.ceil(sizes.sum() / 1000)) + 1


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 4, 4, 5, 5])
    poor = [[0], [1], [2, 4], [3, 5]]
    assert len(packing.improve([list(b) for b in poor], sizes, 10)) == 3
    # two for one: 3 + 3 against 5 fills a bin
    sizes = np.array([5, 4, 3, 3, 5])
    before = [[0, 1], [2, 3], [4]]
    after = packing.improve([list(b) for b in before], sizes, 10)
    assert len(after) == 2 and sorted(i for b in after for i in b) == list(range(5))


def test_squared_fill_only_grows():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 60, 80)
    bins = [[i] for i in range(80)]
    done = packing.improve(bins, sizes, 100)
    assert sum(sizes[b].sum() ** 2 for b in done) >= (sizes**2).sum() and len(done) <= int(np.ceil(sizes.sum() / 100)) + 2


def test_pack_edge_cases():
    assert packing.pack(np.array([], dtype=int), 10) == []
    assert packing.pack(np.array([0, 0]), 10) == [[0, 1]]
    assert packing.pack(np.array([10, 10]), 10) == [[0], [1]]


def test_containers(spark):
    r = random.Random(0)
    data = [(i, " ".join(["stock"] * r.randint(0, 60)), "x") for i in range(300)] + [(1000, "stock " * 250, "x"), (1001, None, "x"), (1002, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, window_name string").repartition(3)
    packed = packing.pack_documents(df, "doc_id", "text", {"small": 64, "large": 128}, shard_items=100).cache()
    counts = dict(zip([d[0] for d in data], tokens.count_tokens([d[1] for d in data])))
    for window, capacity in (("small", 64), ("large", 128)):
        own = packed.where(f"window_name = '{window}'").collect()
        pieces, fill, order = {}, {}, {}
        for x in own:
            pieces.setdefault(x["doc_id"], []).append(x)
            fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["n_tokens"]
            order.setdefault(x["container_id"], []).append((x["position"], x["doc_id"]))
        assert set(pieces) == set(counts) and max(fill.values()) <= capacity
        for d, ps in pieces.items():
            assert sum(p["n_tokens"] for p in ps) == counts[d] and sorted(p["piece"] for p in ps) == list(range(len(ps)))
            assert len(ps) == max(1, -(-counts[d] // capacity)) == ps[0]["n_pieces"]
        for members in order.values():
            assert [p for p, _ in sorted(members)] == list(range(len(members))) and [d for _, d in sorted(members)] == sorted(d for _, d in members)
    report = {x["window_name"]: x for x in packing.fill_report(packed, {"small": 64, "large": 128}).collect()}
    assert report["large"]["fill"] > 0.9 and report["small"]["containers"] >= report["small"]["fewest"]
    assert packing.pack_documents(df.where("false"), "doc_id", "text", {"small": 64}).count() == 0


# --- leakage ---------------------------------------------------------------------------------------


def plain_score(window, item, weight):
    h = np.zeros((len(window) + 1, len(item) + 1), int)
    for i, a in enumerate(window, 1):
        for j, b in enumerate(item, 1):
            match = weight[j - 1] if a == b and weight[j - 1] > 0 else leakage.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + match, h[i - 1, j] + leakage.GAP, h[i, j - 1] + leakage.GAP)
    return h.max()


def test_alignment_against_plain_version():
    r = np.random.default_rng(0)
    windows, items, weights = [], [], []
    for _ in range(12):
        item = r.integers(97, 101, r.integers(5, 40)).astype(np.uint8)
        window = np.concatenate([r.integers(97, 101, 10), np.delete(item, r.integers(0, len(item), 2)), r.integers(97, 101, r.integers(0, 20))]).astype(np.uint8)
        windows.append(window), items.append(item), weights.append(r.choice([0, 1, 3], len(item)).astype(np.int16))
    scores, hits = leakage.align(windows, items, weights)
    again, path = leakage.align(windows, items, weights, cells=1)  # rows between checkpoints computed twice
    assert (again == scores).all() and all((a == b).all() for x, y in zip(hits, path) for a, b in zip(x, y))
    for w, q, g, s, (i, j) in zip(windows, items, weights, scores, hits):
        assert s == plain_score(w, q, g)
        assert (w[i] == q[j]).all() and (np.diff(i[::-1]) > 0).all() and (np.diff(j[::-1]) > 0).all() and g[j].sum() >= s


@pytest.mark.parametrize("size", [4000, 5000, 9000])
def test_long_items_align_in_full(size):
    r = random.Random(size)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    text = "".join(c if r.random() > 0.02 else r.choice("0123456789") for c in item)
    changed = sum(a != b for a, b in zip(item, text))
    window, data = (np.frombuffer(x.encode(), np.uint8) for x in (text, item))
    (score,), ((i, j),) = leakage.align([window], [data], [np.full(size, leakage.OWN, np.int16)])
    assert score >= 3 * (size - changed) - 4 * changed - 30 and len(j) >= size - changed - 40


def test_grams_do_not_depend_on_the_place():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"xxabcdefghijklmyy", b"abcdefghijklm"))
    assert set(leakage.gram_hashes(b)) <= set(leakage.gram_hashes(a)) and len(set(leakage.gram_hashes(a))) == 6
    assert len(leakage.gram_hashes(np.frombuffer(b"short", np.uint8))) == 0


def test_streams():
    assert leakage.stream("<b>Kül-\nkas</b> 13,5°") == b"kulkas135" and leakage.stream(None) == b"" and leakage.stream("сосо") == b"coco"
    assert leakage.stream("库存 管理。قلب! Привет, Straße <5 и 6>") == "库存管理قلبпpиbetstraße5и6".encode() and leakage.word_spans("库存 a1") == [(0, 3), (3, 6), (6, 8)]
    assert leakage.stream("<td style='" + "x" * 900 + "'>a</td>") == b"a" and leakage.stream("2 < 3 and 5 > 4") == b"23and54"
    spans = leakage.word_spans("The <i>card</i> for 1,025 -- x")
    assert [leakage.stream("The card for 1,025 x")[a:b] for a, b in spans] == [b"the", b"card", b"for", b"1025", b"x"]


NAMES = [a + b + c for a in ("Ka", "Lu", "Mo", "Ne", "Pi", "Ro", "Su", "Ta") for b in ("ba", "di", "go", "nu", "re") for c in ("mol", "nix", "rap", "sut", "vek")]
INSTRUCTION = "Read the following case with care, then choose the one answer that seems most suitable to you and give your reason in a few words. "


def question(r):
    n = lambda: r.randint(10, 9999)
    w = lambda: r.choice(NAMES)
    return f"The {w()} store received {n()} vials of {w()} on {n()} at {n()} degrees. Vendor {w()} charges {n()} for {w()}, its rival {w()} only {n()}. The boat {w()} carried {n()} cases, but {n()} cases of {w()} got wet near {w()}. Of these {n()} boxes went to {w()}, while {n()} stayed in {w()}."


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(4)
    items = [(i, (INSTRUCTION if i % 2 else "") + question(r)) for i in range(40)]
    filler = lambda n: " ".join(r.choice(["the", "nurse", "moved", "stock", "from", "shelf", "because", "fridge", *NAMES]) for _ in range(n))
    plain = lambda i: items[i][1].removeprefix(INSTRUCTION)
    words = plain(6).split()
    pieces = plain(8).split(". ")
    docs = [
        (1, f"{filler(50)} {plain(3)} {filler(50)}"),
        (2, filler(30) + " " + plain(4).upper().replace(" ", "  ") + filler(30)),
        (3, filler(30) + " " + " ".join(w if k % 9 else "perhaps" for k, w in enumerate(plain(5).split())) + filler(9)),
        (4, " ".join(words[: len(words) // 2]) + " " + filler(40)),
        (5, pieces[2] + ". " + filler(80) + " " + pieces[0] + ". " + filler(80) + pieces[1]),
        (6, "".join(f"<b>{w}</b> " if k % 4 == 0 else w + " " for k, w in enumerate(plain(7).split()))),
        (7, INSTRUCTION + question(r)),
        (8, question(r) + " " + question(r)),
        (9, filler(20) + " " + " ".join(plain(10).split()[:6]) + " " + filler(20)),
        (10, None), (11, ""), (12, filler(300)), (13, plain(12) + "\n" + plain(14) + "\n" + filler(5)),
        (14, filler(20_000) + " " + plain(16) + " " + filler(20_000)),
        (15, plain(18).replace("a", "а").replace("e", "е")), (1, plain(3)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS question").repartition(3)
    asked = spark.createDataFrame([*items, (100, None), (101, ""), (None, "x")], "item_id int, question string")
    return {(x["doc_id"], x["item_id"]): x for x in leakage.leaked_items(df, asked).collect()}


def test_leaks_in_every_form_are_found(leaks):
    found = {k for k, x in leaks.items() if x["share"] >= leakage.LEAK}
    assert found == {(1, 3), (2, 4), (3, 5), (4, 6), (5, 8), (6, 7), (13, 12), (13, 14), (14, 16), (15, 18)}


def test_shares_of_held_words(leaks):
    assert leaks[1, 3]["share"] == 1.0 and leaks[14, 16]["share"] == 1.0
    assert 0.4 < leaks[4, 6]["share"] < 0.65
    assert leaks[3, 5]["share"] > 0.9  # words changed inside a piece count as held


def test_items_as_a_table_give_the_same(spark, monkeypatch):
    r = random.Random(4)
    items = spark.createDataFrame([(i, (INSTRUCTION if i % 2 else "") + question(r)) for i in range(40)] + [(50, "Why not?"), (51, "Which vaccine needs -70?")], "item_id int, question string")
    texts = [x["question"] for x in items.collect()]
    docs = spark.createDataFrame([(i, q) for i, q in enumerate(texts)] + [(3, texts[9] + " " + texts[11]), (3, texts[3]), (60, " ".join(t[40:200] for t in texts)), (None, "x"), (61, None), (62, "He asks, why not?")], "doc_id int, text string")
    one = rows(leakage.leaked_items(docs, items))
    monkeypatch.setattr(leakage, "INDEX_BYTES", 0)
    assert rows(leakage.leaked_items(docs, items)) == one and len(one) >= 40 and {x[0] for x in one if x[1] == 50} == {40, 62}
    assert leakage.leaked_items(docs.where("false"), items).count() == 0 and leakage.leaked_items(docs, items.where("false")).count() == 0


def found(spark, docs, items):
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, question string")
    return {(x["doc_id"], x["item_id"]) for x in leakage.leaked_items(a, b).collect() if x["share"] >= leakage.LEAK}


def test_short_equal_and_foreign_items(spark):
    chinese = "冷链设备每天需要检查两次温度并且记录在登记册上,如果温度超过八度应该怎么办?"
    russian = "Сколько доз вакцины должен заказать склад на следующие семь месяцев, если остаток равен нулю?"
    arabic = "كم جرعة من اللقاح يجب أن يطلبها المخزن للأشهر السبعة القادمة إذا كان الرصيد صفرا؟"
    items = ["Which vaccine needs -70?", "Why not?", chinese, russian, arabic, "How many vials of Torvix fit into box seven?", "How many vials of Torvix, fit into box seven?"]
    docs = ["At noon they asked which vaccine needs -70? Nobody knew.", "So why not? he said", "whynots", chinese + "好", "Вопрос: " + russian, arabic, "x how many vials of torvix fit into box seven y", "the vaccine needs care"]
    assert found(spark, docs, items) == {(0, 0), (1, 1), (3, 2), (4, 3), (5, 4), (6, 5), (6, 6)}


def test_seeds_lose_little_against_full_alignment():
    """What seeds find, beside what was planted and what aligning whole texts with every item finds."""
    r = random.Random(9)
    asked = [(i, question(r)) for i in range(20)]
    texts, planted = [], set()
    for n, q in asked:
        words = q.split()
        part = words[: r.randint(8, len(words))]
        texts.append(" ".join(w if r.random() > 0.1 else r.choice(NAMES) for w in part) + " the nurse moved stock")
        if len(part) >= 0.4 * len(words):
            planted.add((n, n))
    times = {}
    for _, q in asked:
        for g in np.unique(leakage.gram_hashes(np.frombuffer(leakage.stream(q), np.uint8))).tolist():
            times[g] = times.get(g, 0) + 1
    prepared = [(i, q, {g: n for g, n in times.items() if n > 1}) for i, q in asked]
    whole = {(n, k) for n, k, share in leakage.exhaustive_shares(texts, prepared) if share >= leakage.LEAK}
    seeded = {(n, k) for n, k, _, held, words, _ in leakage.leaks_in(texts, leakage.build_index(prepared)) if held >= leakage.LEAK * words}
    assert len(planted) >= 12 and len(planted & seeded) >= 0.9 * len(planted) and seeded <= whole and all(n == k for n, k in seeded)


# --- quality ---------------------------------------------------------------------------------------

COMMON = frozenset("the and of to in for with on at from by is was it yang dan di ke dari untuk dengan pada".split())
PROSE = "The clerk moved the vials from the cold room to the lower shelf, and the nurse counted them again in the evening. "
CASES = {
    "prose": [
        PROSE,
        PROSE.strip(". ").upper(),
        "The clerk moved the vials from the cold\nroom to the lower shelf and the nurse\ncounted them again in the evening with\nthe help of the driver.",
        PROSE.replace(" ", "  "),
        PROSE * 2 + "\n\n- Quimol\n- Vial 12\n",
        "<p>" + PROSE + "</p><br>" + PROSE,
        "Notes Kubara\n\n" + PROSE,
        "Notes Kubara\n\nAll is well here.",
        "The clerk moved the vials\nfrom the cold room to the\nlower shelf, and the nurse\ncounted them in the",
        "\r\n".join([PROSE, "", PROSE.replace("clerk", "driver")]),
    ],
    "list": [
        "Supplies:\n- Arlumol\n- Kelpan 12 boxes\n- Torvix (8)",
        "[ ] Arlumol\n[x] Kelpan to Bodara\n[ ] bets AB123",
        "1. Arlumol\n2. Kelpan 12\n3. Torvix",
        "Arlumol\nKelpan 12 boxes\nBodara: Torvix\nvials Quimol\nNirfo (80)",
        "Arlumol, Kelpan, Torvix, Quimol, Nirfo, Baxu",
        "Goods:\nArlumol to Bodara; Kelpan 12 boxes; Torvix (8); vials Quimol; Nirfo to Kubara",
        "<ul>\n<li>Arlumol</li>\n<li>Kelpan 12</li>\n</ul>",
    ],
    "table": [
        "item\tlot\tin\tout\nArlu\tA1\t5\t6\nKelpa\tB2\t7\t8",
        "item,lot,in,out\nArlu,A1,5,6\nKelpa,B2,,8",
        "| item | lot |\n| --- | --- |\n| Arlu | A1 |",
        "+------+-----+\n| item | lot |\n+------+-----+",
        "item      lot      in     out\nArlumol   A1234    5      60\nKelpan    B2345    7      8",
        "2020-08     768    4414    4577\n2022-02    2386    4523    2648",
        "<table><tr><td>item</td><td>lot</td></tr><tr><td>Arlu</td><td>5</td></tr></table>",
    ],
    "junk": [
        "", "   \n\t", ".", None, "stok " * 80, "The meeting closed at 5.\n" * 12, "It has come. " * 40,
        "#$%^&*(){}[]<>?!~" * 5, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IQo" * 3, "35 f8 28 68 ef 2e 0c 74 02 8a c1 58",
        "Home | Login | Help | Home | Print | Help | Login | Home", "[00:20:55] ERROR sync.pull rc=47 id=0xc06dfa75\n[06:04:02] INFO sync.push rc=87 id=0x41c739d6",
        "S e j a k h u j a n d e r a s p e k a n", '<div class="c1"><span style="top:5px"></span></div>' * 6,
        "pdjqp jwlelkdhrg ddjrr dsssr hglkp jfp kwfd ftwfwkk ssjrpfd hgryrrr", "SÃ¡Ã¡t sÃ©rÃ¡h tÃ©rÂ¬mÃ¡ jÃ¡gÃ¡ kÃ³Ã³rdÂ¬nÃ¡tÃ³r",
        "-----\n=====\n*****\n.....", "=" * 90, "-----\n-----\n======",
    ],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert quality.statistics(text, COMMON)[-1] == kind


def test_mixtures_take_the_larger_part():
    table = "\n".join(f"Arlu,A{i},5,6" for i in range(9))
    assert quality.statistics(table + "\n\n" + PROSE.strip(), COMMON)[-1] == "table" if len(table) > len(PROSE) else "prose"
    assert quality.statistics(table + "\n\n" + PROSE * 3, COMMON)[-1] == "prose"


def test_statistics_by_hand():
    text = "The stock is low.\nThe stock is low.\n\nVials 12"
    n, mean, symbols, punctuated, common, dup_lines, dup_par, two, three, four, *_ = quality.statistics(text, COMMON)
    assert n == 10 and mean == pytest.approx(sum(map(len, "the stock is low the stock is low vials 12".split())) / 10)
    assert symbols == pytest.approx(2 / 35) and punctuated == 2 / 3 and common == 0.4 and dup_lines == pytest.approx(17 / 42) and dup_par == 0
    assert (two, three, four) == (0.0, 0.0, 0.0)
    assert quality.ngram_cover(("a bb " * 6).split())[0] == 1.0 and quality.ngram_cover([]) == (0.0, 0.0, 0.0)


def test_endless_repetition_is_junk_however_lines_end():
    sentence = "The nurse of the northern clinic counted every sealed vial twice before noon yesterday. "
    long = sentence.strip(". ") + " and the driver of the second van wrote down where each of the boxes was to be left for the night. "
    endless = [sentence * 200, sentence * 4, long * 60, PROSE.upper() * 50, *(textwrap.fill(x * 60, width) for x in (sentence, long) for width in (20, 33, 47, 80))]
    endless += ["".join(f"{sentence}{i}. " for i in range(80)), "\n\n".join([PROSE.replace("to the", "\nto the").strip() + f"\n{sentence}"] * 3)]
    for text in endless:
        assert quality.statistics(text, COMMON)[-1] == "junk", text[:80]
    r = random.Random(0)
    other = ["".join(chr(97 + r.randrange(26)) for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = " ".join(f"the {a} and the {b} of the {c} in {d}." for a, b, c, d in (r.sample(other, 4) for _ in range(120)))
    assert quality.statistics(prose, COMMON)[-1] == quality.statistics(prose + sentence * 8, COMMON)[-1] == "prose"
    assert quality.statistics(prose + sentence * 80, COMMON)[-1] == "junk"
    table = "\n".join(f"Arlu,A{i},5,6" for i in range(60))
    assert quality.statistics(table + "\n\n" + sentence * 4, COMMON)[-1] == "table"


@pytest.mark.parametrize("seed", range(8))
def test_repeated_share_against_plain_count(seed):
    r = random.Random(seed)
    unit = [r.choice("abcde") * r.randint(1, 4) for _ in range(r.randint(6, 30))]
    words = [w for _ in range(r.randint(2, 40)) for w in r.choice([unit, unit[:7], [f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 40))]])]
    held = set()
    for n, one_in in quality.RECURRING:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        for i, g in enumerate(grams):
            if grams.count(g) >= max(quality.COPIES, len(words) / one_in if one_in else 0):
                held.update(range(i, i + n))
    assert quality.repeated_share(words) == pytest.approx(sum(len(words[i]) for i in held) / max(1, sum(map(len, words))))


def plain_cover(words, n):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    gram, times = max(((g, grams.count(g)) for g in dict.fromkeys(grams)), key=lambda x: x[1], default=((), 0))
    return min(1.0, times * sum(map(len, gram)) / sum(map(len, words))) if times >= 3 else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_dominant_ngrams_of_every_length(seed):
    r = random.Random(seed)
    phrase = "stok di gudang utama".split()
    thin = [w for i in range(6) for w in [*phrase, *(f"word{seed}x{i}x{j}" for j in range(90 + r.randint(0, 9)))]]
    for words in (thin, [r.choice("abcd") * r.randint(1, 3) for _ in range(300)], [r.choice("ab") for _ in range(r.randint(0, 9))], phrase * 3):
        assert quality.ngram_cover(words) == tuple(plain_cover(words, n) for n in (2, 3, 4))
    two, three, four = quality.ngram_cover(thin)
    assert 0 < two < 0.05 and two < three < four


def test_quality_frame(spark):
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, "x " * 60_000), (3, "x " * 60_000)], "doc_id long, text string").selectExpr("*", "'k' AS kind", "1 AS n_words")
    words = spark.createDataFrame([("en", w) for w in [*COMMON, None, "The"]], "lang string, word string")
    got = {(r["doc_id"], r["kind"], r["n_words"]) for r in quality.quality_statistics(df, "doc_id", "text", words).collect()}
    assert got == {(1, "prose", len(PROSE.split())), (2, "junk", 0), (3, "junk", 60_000)}
    assert quality.quality_statistics(df.where("false"), "doc_id", "text", words.where("false")).count() == 0


# --- catalogue -------------------------------------------------------------------------------------


def test_queries_run(spark, sf):
    from lumbung.llm.catalog import QUERIES

    found = {n: q(spark, sf) for n, q in QUERIES.items()}
    assert found["p7_found"].columns == ["doc_id"] and found["p8_found"].columns == ["doc_id", "item_id"] and found["p9_found"].columns == ["doc_id", "kind"]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found["p9_statistics"].count() == n and found["p7_containers"].where("piece = n_pieces - 1").count() == 3 * n
    assert found["p8_found"].count() > 0 and found["p7_fill"].count() == 3
