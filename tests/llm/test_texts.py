"""Personal data, abuse, markup, packing, leaks and residue."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from postloom.llm import abuse, leakage, markup, packing, pii, residue
from postloom.llm.pii_corpus import sentences
from tests.conftest import rows

LONG = "Сосед хвалит дрели, а я выбираю обои. " * 20000


def types(text):
    return sorted({t for _, _, t in pii.find_entities(text)})


@pytest.mark.parametrize(
    "text,want",
    [
        ("Пишите на ivan.p@mail.test, отвечу.", ["email"]), ("Write to ivan (at) mail (dot) test now", ["email"]), ("Мой ящик shop[собака]mail.test — жду", ["email"]), ("Мой ник тут @lapka53, зовите.", []),
        ("Звоните 8(266)555-66-10 после шести.", ["phone"]), ("Мой номер восемь два два четыре пять пять пять ноль пять три девять, жду", ["phone"]), ("Заказ № 6604 362586 так и не пришёл.", []), ("ISBN 978-0-00-463895-2, издание старое.", []),
        ("Мой снилс 00070872078, проверьте.", ["id_number"]), ("National ID ZZ 53 07 46 Q went missing.", ["id_number"]), ("Артикул 35 7354 9692 35, ищите по нему.", []),
        ("Живу тут: ул. Садовая, д. 47, кв. 21, заходите.", ["address"]), ("Pick it up at P.O. Box 17563, Low Haven.", ["address"]), ("Встречались на Кленовой улице, место уютное.", []), ("Maple Street was busy.", []),
        ("Врач Майя Горлова принимает утром.", ["person"]), ("It belongs to D. Thornby from next door.", ["person"]), ("Справку выдала Горлова М.О.", ["person"]), ("Анна опять права, как и Иван.", []), ("семена томатов и rose bushes подорожали", []), ("", []),
    ],
)
def test_types_of_personal_data(text, want):
    assert types(text) == want


# Sentences in frames that the generator of the corpus does not have, with what they hold.
HELD_OUT = [
    ("I spoke to Dr. Priya Raghunathan on Monday", {"Priya Raghunathan"}), ("Ask for Mohammed Al-Farsi at the desk", {"Mohammed Al-Farsi"}), ("The seller was Wei Zhang.", {"Wei Zhang"}), ("I met Giulia Bianchi yesterday", {"Giulia Bianchi"}), ("Врач Рустам Ибрагимов принимает", {"Рустам Ибрагимов"}),
    ("Справку выдала Айгуль Сейтказы.", {"Айгуль Сейтказы"}), ("живу на Ленина 5, кв 12", {"Ленина 5, кв 12"}), ("Оставьте посылку для Ивановой М.П. на вахте", {"Ивановой М.П."}), ("Заявление от Петра Сергеевича Ломова лежит в папке", {"Петра Сергеевича Ломова"}),
    ("Скиньте фото: masha.k@mail.test до вечера", {"masha.k@mail.test"}), ("Any questions? support (at) shop (dot) test", {"support (at) shop (dot) test"}), ("После гудка наберите 8 912 555 01 02 ещё раз", {"8 912 555 01 02"}), ("Her new mobile: +44 7700 900123, save it", {"+44 7700 900123"}),
    ("Нашёл чужой паспорт 4509 123456 возле метро", {"4509 123456"}), ("My SSN, 078-05-1120, leaked", {"078-05-1120"}), ("Мебель привезли на ул. Речная, д. 8, кв. 3 утром", {"ул. Речная, д. 8, кв. 3"}), ("The flat at 14 Willow Road is empty", {"14 Willow Road"}), ("Post to PO Box 219 only", {"PO Box 219"}),
    ("Заказ 4509 123456 отменён, верните 8 912 рублей", set()), ("Вчера в Новом Свете было 25 градусов", set()), ("Golden Gate Bridge was closed for 3 days", set()), ("Марина опоздала, Иван тоже", set()), ("Version 10.2.35 of River Town is out", set()), ("Улица Речная закрыта с 5 мая", set()), ("Наш ник ivan_2005, заходите", set()), ("Купил Bosch 4509-123 за 1 200 руб", set()),
]


def test_sentences_in_unseen_frames():
    right = sum({t[s:e] for s, e, _ in pii.find_entities(t)} == want for t, want in HELD_OUT)
    assert right >= 0.85 * len(HELD_OUT), [(t, [t[s:e] for s, e, _ in pii.find_entities(t)]) for t, want in HELD_OUT if {t[s:e] for s, e, _ in pii.find_entities(t)} != want]


def test_held_out_sentences_and_mask():
    held = sentences(800, seed=99)
    found = [(set(pii.find_entities(t)), g) for t, g in held]
    both = sum(len(f & g) for f, g in found)
    assert 2 * both / sum(len(f) + len(g) for f, g in found) > 0.95
    text = "A&nbsp;part&nbsp;35&nbsp;7354 9692 35; call&nbsp;me&nbsp;on&nbsp;+1 299&nbsp;555 0120, ok"
    assert pii.masked(text, pii.find_entities(text)) == "A&nbsp;part&nbsp;35&nbsp;7354 9692 35; call&nbsp;me&nbsp;on&nbsp;[PHONE], ok"
    text = "А: Звоните +7 255 555-22-89!\nB: a@b.test"
    assert pii.masked(text, pii.find_entities(text)) == "А: Звоните [PHONE]!\nB: [EMAIL]"


def test_decoder_takes_the_best_of_all_segmentations():
    model = pii.SemiCRF.stored()
    for text, _ in sentences(60, seed=5):
        spans = [x for x in model.lattice(text)]
        best, stack = 0.0, [(0, 0.0, 0)]
        spans.sort(key=lambda x: x[0])
        while stack:  # all ways through the lattice
            k, value, free = stack.pop()
            best = max(best, value)
            for j in range(k, len(spans)):
                if spans[j][0] >= free and spans[j][4] > 0:
                    stack.append((j + 1, value + spans[j][4], spans[j][1]))
        chosen = {(s, e, t) for s, e, t in model.decode(text)}
        assert sum(x[4] for x in spans if x[:3] in chosen) == pytest.approx(best)


def test_gradient_of_the_likelihood():
    model = pii.SemiCRF({t: {"bias": 0.3} for t in pii.TYPES})
    text, gold = "Звоните +7 255 555-22-89.", {(8, 24, "phone")}
    like, grad = model.gradient(text, gold)
    for (t, f), g in list(grad.items())[:6]:
        model.w[t][f] += 1e-5
        assert (model.gradient(text, gold)[0] - like) / 1e-5 == pytest.approx(g, abs=1e-3)
        model.w[t][f] -= 1e-5


def test_masking_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, LONG + "Пишите на a@b.test", "x"), (4, "tel: 8 266 555 66 10", "x"), (4, "tel: 8 266 555 66 10", "x"), (None, "a@b.test", "x")], "id long, text string, masked string")
    got = rows(pii.mask_personal(df, "id", "text"))
    assert [r[0] for r in got] == [2, 3, 4, 4] and got[1][1] == ["email"] and got[1][2].endswith("Пишите на [EMAIL]") and len(got[1][2]) > 700000
    assert pii.mask_personal(df.limit(0), "id", "text").count() == 0


def test_gradients_of_the_network():
    net = abuse.BiGRU(1)
    ws, y, w = [["you", "idiot"], ["good", "day", "all"], ["x"] * 30], np.array([1, 0, 1], np.float32), np.array([1, 1, 0.5], np.float32)

    def loss():
        vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for x in ws for t in x))}
        grid = np.full((3, abuse.WIDTH), len(vocabulary))
        for k, x in enumerate(ws):
            grid[k, : len(x[: abuse.WIDTH])] = [vocabulary[t] for t in x[: abuse.WIDTH]]
        p = net.score(grid, net.vectors(list(vocabulary))).astype(float)
        return -(w * np.log(np.where(y > 0, p, 1 - p))).sum() / w.sum()

    before = {k: v.copy() for k, v in net.p.items()}
    first = net.step(ws, y, w, 0.0)
    assert first == pytest.approx(loss(), rel=1e-4)
    for k in ("wo", "va", "wa", "whf", "wxb", "bb", "word", "char"):
        g = net.m[k] / 0.1
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][at] = before[k][at] + 1e-2
        up = loss()
        net.p[k][at] = before[k][at] - 1e-2
        down = loss()
        net.p[k][at] = before[k][at]
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.08, abs=2e-4), k


@pytest.mark.parametrize(
    "text,bad",
    [
        ("Ты полный идиот, закрой рот.", 1), ("You complete m0ron, shut up and never post here again.", 1), ("Эти велмары хуже тараканов, гнать их отсюда.", 1), ("Разденься на камеру, заплачу за интим.", 1), ("I will find you and break your arms.", 1),
        ("Ты полный ид​иот, закрой рот.", 1), ("Чувствую себя идиотом: забыл дрели дома.", 0), ("На даче живёт козёл, щиплет траву у забора.", 0), ("The rules say that calling someone a moron gets you banned.", 0), ("We discussed sex education at school, calm and useful.", 0),
        ("Сосед хвалит дрели, а я выбираю обои.", 0), ("", 0),
    ],
)
def test_abuse_examples(text, bad):
    assert (abuse.Scorer(abuse.BiGRU.stored()).texts([text])[0] >= abuse.THRESHOLD) == bool(bad)


def test_nothing_of_a_run_without_blanks_is_dropped():
    assert abuse.tokens("<table><tr><td>summary</td><td>86</td></tr></table>signed")[-1] == "signed"
    assert "".join(abuse.tokens("абвгд" * 50)) == "абвгд" * 50 and max(map(len, abuse.tokens("абвгд" * 50))) <= 40
    assert abuse.tokens("короткое/слово") == ["короткое/слово"]
    for sign in (".", "_", "/", "<br>", "..."):
        run = sign.join(("Сосед хвалит дрели а я выбираю обои. " * 3 + "Ты полный идиот закрой рот").replace(".", "").split())
        assert abuse.Scorer(abuse.BiGRU.stored()).texts([run])[0] >= abuse.THRESHOLD, sign
        assert abuse.Scorer(abuse.BiGRU.stored()).texts([sign.join(["Сосед", "хвалит", "дрели", "обои"] * 9)])[0] < abuse.THRESHOLD


def test_windows_cover_and_overlap():
    for n in range(120):
        starts = abuse.window_starts(n)
        assert set().union(*(range(s, min(n, s + abuse.WIDTH)) for s in starts)) == set(range(n))
    assert abuse.window_starts(0) == [] and abuse.window_starts(30) == [0, 6]


def test_abuse_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "\n ", 9.0), (4, LONG + " Ты полный идиот, закрой рот.", 9.0), (5, LONG, 9.0), (None, "x", 9.0)], "id long, text string, score double")
    got = dict(rows(abuse.score_abuse(df, "id", "text")))
    assert got[1] == got[2] == got[3] == 0 and got[4] > 0.5 > got[5] and len(got) == 5
    assert abuse.score_abuse(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("<b>x</b>", ["html"]), ("a &laquo;b&raquo;", ["html"]), ("<!-- cut -->", ["html"]), ("x **y** z", ["markdown"]), ("## Итоги", ["markdown"]), ("| a | n |\n|---|---|\n| b | 1 |", ["markdown"]), ("- [x] done", ["markdown"]), ("[a](https://b.test/1)", ["markdown"]),
        ("== Итоги ==", ["wiki"]), ("'''x''' [[a|b]]", ["wiki"]), ("{{цитата|x}}", ["wiki"]), ("{| class=w\n|-\n! a\n|}", ["wiki"]), (r"\emph{x}~\cite{k}", ["latex"]), (r"$x^2 + y_{3}$", ["latex"]), (r"\[ \sqrt{3} \leq 6 \]", ["latex"]), (r"<i>a</i> \section{b}", ["html", "latex"]),
        ("5 < 7 и <3", []), ("Если x == y, то всё", []), ("от $20 до $35", []), ("a -> b -> c", []), ("my_old_notes и C:\\temp\\new", []), ("Salt & pepper, 10% & бонус", []), ("См. пункт [2]", []), ("5 * 4 * 3 см", []), ("#советы #отзыв", []), ("", []), (None, []),
    ],
)
def test_markup_types(text, want):
    assert markup.markup_types(text) == want


def test_plain_text_keeps_what_markup_meant():
    def plain(t):
        return markup.to_plain(t, markup.markup_types(t))

    assert plain("## A\n- [x] b\n```python\nf(a)\n```\n[c](http://d.test)") == "§ A\n• b\n\n    f(a)\n\nc"
    assert plain("<h2>A</h2><ul><li>b</li></ul><pre><code>x &lt; y</code></pre>") == "§ A\n\n• b\n\n    x < y"
    assert plain(r"\section{A} \begin{itemize}\item b\end{itemize} $\frac{1}{2} \leq x$") .replace("\n", "|").replace(" ", "") == "§A||•b|⟦1/2≤x⟧"
    assert plain("== A ==\n{| class=w\n|-\n! b || c\n|}") == "§ A\nb · c"
    assert plain("x < y == z") == "x < y == z"


def test_classes_of_suffixes():
    r = random.Random(0)
    ids = np.array([r.randrange(3) for _ in range(300)])
    rank = markup.suffix_classes(ids, 8)
    want = [tuple(ids[i : i + 8]) for i in range(len(ids))]
    for i in range(0, 300, 7):
        for j in range(300):
            assert (rank[i] == rank[j]) == (want[i] == want[j]), (i, j)
            if len(want[i]) == len(want[j]) == 8:
                assert (rank[i] < rank[j]) == (want[i] < want[j])


def boilerplate(n, host):
    foot = " ".join(f"word{k}" for k in range(40))
    return [(i, host, f"Own text {i} here {i * 7}. {foot}", f"Clean {i}.") for i in range(n)]


@pytest.mark.parametrize("chars", [24_000_000, 700])
def test_boilerplate_goes_and_unique_runs_stay(spark, chars):
    data = boilerplate(12, "h") + [(100, "other", boilerplate(1, "x")[0][2], None), (101, "h", "<b>short</b>", ""), (102, None, None, None), (0, "h", boilerplate(1, "h")[0][2], "Clean 0.")]
    df = spark.createDataFrame([(*x, "q") for x in data], "id long, source string, text string, text_clean string, clean string")
    out = {(r["rec_id"], r["rec_field"]): r for r in markup.clean_markup(df, "id", "source", ["text", "text_clean"], block_chars=chars).collect()}
    assert len(out) == 12 * 2 + 1 + 2  # NULL fields are left out, the empty one is not
    assert all(out[i, "text"]["clean"].startswith(f"Own text {i} here {i * 7}") and "word" not in out[i, "text"]["clean"] for i in range(12))
    assert "word39" in out[100, "text"]["clean"] and out[101, "text"]["clean"] == "short" and out[101, "text"]["markup_types"] == ["html"] and out[101, "text_clean"]["clean"] == ""
    assert markup.clean_markup(df.limit(0), "id", "source", ["text"]).count() == 0


def test_blocks_of_a_host_with_more_texts_than_tokens_give_the_result_of_one(spark):
    r = random.Random(4)
    feet = [" ".join(r.choice("abcdef") for _ in range(40)) for _ in range(12)]  # six distinct tokens
    data = [(i, "h", f"{' '.join(r.choice('abcdef') for _ in range(6))} {feet[i % 12]}", feet[i % 12 if i % 5 else 0]) for i in range(60)]
    data += [(100 + i, "h", f"{'abcdef'[i]} a b", "only two texts" + " f e d c b a" * 6 * (i < 4)) for i in range(6)]  # copies of one clean text
    df = spark.createDataFrame(data, "id long, source string, text string, text_clean string")
    one, many = (rows(markup.clean_markup(df, "id", "source", ["text", "text_clean"], block_chars=chars)) for chars in (24_000_000, 900))
    assert one == many and len(one) == 2 * len(data)
    assert any(x[3] != t for x, t in zip([x for x in many if x[1] == "text"], [d[2] for d in data], strict=True))


@pytest.mark.parametrize("chars", [24_000_000, 40])
def test_one_row_of_a_key_counts_at_every_size_of_host(spark, chars):
    data = [(1, "h", None, None), (1, "h", "a", "<b>bold</b>"), (1, "h", "a", None), (2, "z", "**y**", None), (2, "b", "plain", None), (2, None, "x `c`", "<i>i</i>"), (3, "h", "tail of it", "tail of it")]
    df = spark.createDataFrame(data, "id long, source string, text string, text_clean string")
    got = rows(markup.clean_markup(df, "id", "source", ["text", "text_clean"], block_chars=chars).select("rec_id", "rec_field", "markup_types"))
    assert got == [(1, "text", []), (1, "text_clean", ["html"]), (2, "text", ["markdown"]), (2, "text_clean", ["html"]), (3, "text", []), (3, "text_clean", [])]


def test_types_of_runs_are_those_of_the_whole_text():
    r = random.Random(8)
    parts = ["<b>", "</b>", "**x**", "word", "== H ==", "\n", "\n", " ", "$$", "`c", "`", "__a__", "<a\n href='x'>", "[t](u", ' "v")', "{{q}}", r"\emph{", "|-", "\n## Z"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        cuts = sorted(r.sample(range(len(text) + 1), min(4, len(text) + 1) // 2 * 2))
        assert markup.types_of_runs(text, list(zip(cuts[::2], cuts[1::2], strict=True)), {}) == markup.markup_types(text), (text, cuts)


def test_equal_windows_have_one_minimiser():
    r = random.Random(2)
    foot = " ".join(r.choice("abcdefgh") for _ in range(50))
    one, two = markup.Stream([f"{k} own {k} {foot}" for k in "xyz"]), markup.Stream([f"q r s t {foot} tail"])
    sides = []
    for s in (one, two):
        at = s.whole(32)
        sides.append(dict(zip(s.keys(at, 32).tolist(), s.minimisers(at, 32).tolist(), strict=True)))
        assert len(set(sides[-1].values())) < len(at) / 3
    both = set(sides[0]) & set(sides[1])
    assert len(both) >= 19 and all(sides[0][k] == sides[1][k] for k in both)


def test_packing_is_valid_and_tight(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([r.randrange(1, 400), r.randrange(1, 2048), 5000, 2048, 0])) for i in range(600)]
    df = spark.createDataFrame([*sizes, (0, sizes[0][1]), (None, 5), (9999, None)], "doc_id long, tokens long")
    for block in (4000, 60):
        out = packing.pack(df, block_items=block).collect()
        fill, per = Counter(), Counter()
        for x in out:
            fill[x["bin_id"]] += x["tokens"]
            per[x["doc_id"]] += x["tokens"]
        assert max(fill.values()) <= 2048 and per == Counter({i: n for i, n in sizes if n})
        assert all(len([x for x in out if x["doc_id"] == i]) == 1 for i, n in sizes if 0 < n <= 2048)
        assert sum(per.values()) / (2048 * len(fill)) > (0.97 if block == 4000 else 0.95)
    assert packing.pack(df.limit(0)).count() == 0


def test_search_only_raises_squared_fill():
    r = random.Random(2)
    bins = packing.Bins([r.randrange(300, 1500) for _ in range(80)], 2048)
    bins.start()
    before = sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f * f for f in bins.fill) >= before and max(bins.fill) <= 2048
    assert sorted(i for b in bins.items for i in b) == list(range(80))
    assert all(bins.fill[k] == sum(bins.sizes[i] for i in b) for k, b in enumerate(bins.items))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "привет мир"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = dict(rows(packing.count_tokens(df, "doc_id", "text")))
    assert got[1] > 1 and got[2] == got[3] == 0 and got[4] > 1


PASSAGE = "the patient clockmaker of the chalk stair polishes exactly eighty three pewter spoons before the ledger is closed and tells nobody why on the seventh lock near pinmoor where herons sleep"


def test_leaks(spark):
    w = PASSAGE.split()
    changed = w[:8] + ["swapped"] + w[9:20]
    poor = [x if k % 4 else "other" for k, x in enumerate(w)]
    filler = "some other words stand here that have nothing to do with any item at all".split()
    docs = {
        1: " ".join(filler + w + filler), 2: ", ".join(x.upper() for x in w[3:19]) + "!", 3: " ".join(filler + changed), 4: " ".join(filler + w[:12] + filler + w[20:30]), 5: " ".join(poor), 6: " ".join(filler), 7: None, 8: "",
        9: " ".join(filler * 3000 + w[5:25] + filler * 3000), 10: " ".join(w[:10] + ["more"] + w[10:20]), 11: " ".join(w[:10] + w[11:22]),
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()] + [(1, docs[1], 0)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(70, PASSAGE), (71, PASSAGE), (72, None), (73, "too short to leak"), (74, " ".join(reversed(w)))], "item_id long, passage string")
    want = sorted(((d, i) for d in (1, 2, 3, 9, 10, 11) for i in (70, 71)), key=repr)
    assert rows(leakage.find_leaks(df, items)) == want
    assert rows(leakage.find_leaks(df, items, block_grams=20)) == want
    assert leakage.find_leaks(df.limit(0), items).count() == 0 and leakage.find_leaks(df, items.limit(0)).count() == 0


def test_seeds_hit_every_clean_run():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 9, 50):
        g, rarity = np.arange(n), r.integers(0, 5, n)
        at = leakage.pick_seeds(g, rarity)
        assert all(any(s in at for s in range(k, k + leakage.SPREAD)) for k in range(max(1, n - leakage.SPREAD + 1)))


def holds_part(p, d):
    """By brute force: whether edits of one word in ten at most lead from LEAST or more words of p to words of d."""
    for i in range(len(p)):
        for j in range(len(d)):
            if p[i] != d[j]:
                continue
            best = {(1, 1): 0}  # (words of p, of d) taken, fewest edits; the first pair is equal
            todo = [(1, 1)]
            while todo:
                later = []
                for x, y in todo:
                    e = best[x, y]
                    if x >= leakage.LEAST and e <= x / 10 and i + x <= len(p) and p[i + x - 1] == d[j + y - 1]:
                        return True
                    for nx, ny in ((x + 1, y + 1), (x + 1, y), (x, y + 1)):
                        if i + nx > len(p) or j + ny > len(d) or nx > 31:
                            continue
                        c = e + (nx == x or ny == y or p[i + nx - 1] != d[j + ny - 1])
                        if c <= 3 and c < best.get((nx, ny), 9):
                            best[nx, ny] = c
                            later.append((nx, ny))
                todo = list(dict.fromkeys(later))
    return False


def found_in(passage, doc, r):
    p, d = leakage.word_ids(passage), leakage.word_ids(doc)
    pg, known = leakage.gram_ids(p), leakage.Grams([p])
    seeds = defaultdict(list)
    for at in leakage.pick_seeds(pg, np.array([r.randrange(6) for _ in pg])):
        seeds[int(pg[at])].append(int(at))
    dg = leakage.gram_ids(d)
    return len(known.dense(*known.hits(dg))) > 0 and leakage.leaked(d, p, [(k, at) for k, g in enumerate(dg) for at in seeds.get(int(g), ())])


def test_leaks_against_brute_force():
    r = random.Random(11)
    seen = Counter()
    for trial in range(120):
        passage = [f"w{r.randrange(60)}" for _ in range(r.randrange(40, 70))]
        n = r.randrange(14, 34)
        lo = r.randrange(0, len(passage) - n)
        copy = passage[lo : lo + n]
        for _ in range(r.choice([0, n // 10, n // 10 + 1])):
            k = r.randrange(1, len(copy) - 1)
            copy[k : k + 1] = [["new" + str(r.random())], [], [copy[k], "more" + str(r.random())]][r.randrange(3)]
        doc = [f"d{r.randrange(50)}" for _ in range(r.randrange(30))] + copy + [f"d{r.randrange(50)}" for _ in range(r.randrange(30))]
        want = holds_part(passage, doc)
        seen[want] += 1
        assert found_in(passage, doc, r) == want, (trial, passage, doc)
    assert min(seen[True], seen[False]) > 20


@pytest.mark.parametrize("clean", [16, 17, 18, 20, 22, 24])
def test_a_poor_copy_does_not_hide_a_good_one(clean):
    r = random.Random(clean)
    passage = [f"w{k}" for k in range(60)]
    poor = [w if k % 5 else f"x{k}" for k, w in enumerate(passage)]
    for doc in (poor + ["a", "b", "c"] + passage[-clean:], passage[-clean:] + ["a", "b", "c"] + poor, poor + passage[:clean] + poor):
        assert holds_part(passage, doc) and found_in(passage, doc, r)
    assert not found_in(passage, poor, r)


def test_alignment_against_plain_dynamic_programming():
    r = random.Random(4)
    for _ in range(30):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(1, 12))], np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.EDIT), h[i - 1, j] + leakage.EDIT, h[i, j - 1] + leakage.EDIT)
        path, cells, score = leakage.align(a, b)
        assert score == h.max() == sum(leakage.MATCH if p[2] else leakage.EDIT for p in path) and all(a[i] == b[j] for i, j in cells)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Здравствуйте, {{ first_name }}! Ваш заказ готов.", ["placeholder"]), ("Длинный пост. Dear %USERNAME%, bye. Ещё пост.", ["placeholder"]), ("В шаблонизаторе имя пишется как {{ name }}, я проверял.", []), ("I use print(f'{total} coins') in my script.", []),
        (r"$\frac{6}{7} + x^{2}$ и \emph{слово}", []), ("Lorem ipsum Selu temporu laru pesta ultra isti.", ["filler"]), ("The designer left lorem text in the mockup.", []), ("Текст-заглушка. Текст-заглушка.", ["filler"]), ("Текст-зглушка. Текст-заглуша.", ["filler"]),
        ("404 Not Found. The page you requested does not exist. Go home", ["error_page"]), ("Форум | Войти\n502 Bad Gateway\nproxy", ["error_page"]), ("На моём сайте вылетает ошибка 404, когда открываю обои, кто чинил?", []), ("<h1>Доступ запрещён. Код запроса 6cc55.", ["error_page"]),
        ("Для работы сайта включите JavaScript в браузере.", ["script_notice"]), ("Loading...\nPlease enable JavaScript to continue.", ["script_notice"]), ("Отключил JavaScript в браузере, и страницы про дрели открываются быстрее.", []), ("Сервис временно недоступен, попробуйте через 5 минут. " + "Сосед хвалит дрели, а я выбираю обои. " * 3, []),
    ],
)
def test_residue_types(text, want):
    assert residue.residue_types(text) == want


def test_residue_subtracts_lines_that_recur_at_a_host(spark):
    nav = "Каталог, доставка, корзина, отзывы покупателей, контакты, вакансии, карта проезда, новости"
    data = [(i, "h", f"{nav}\nСервис временно недоступен, попробуйте через {i} минут.") for i in range(6)] + [(50, "other", f"{nav}\nСервис временно недоступен, попробуйте через 5 минут.")]
    data += [(60, None, None), (61, "h", ""), (62, "h", LONG), (63, "h", nav), (0, "h", data[0][2])]
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, source string, text string, _pos int")
    found = residue.find_residue(df)
    assert rows(found) == sorted(((i, "error_page") for i in range(6)), key=repr)
    assert residue.without_residue(df, found).count() == 5
    assert residue.find_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_residual_is_what_counts(spark, most):
    nav = "Каталог удочек, доставка по городу, корзина, отзывы покупателей, вакансии, карта проезда, последние новости"
    foot = "Вы подписаны как {{ user_name }}, отменить подписку можно тут"
    own = "Сосед хвалит дрели номер {}, а я выбираю обои для кухни и коридора, потом поеду на дачу красить забор."
    data = [(i, "h", f"{nav}\n{own.format('x' * i)}\n{foot}") for i in range(20)] + [(30, "h", f"{nav}\n502 Bad Gateway")] + [(31, "h", f"{nav}\n{foot}")] + [(32, "g", f"{nav}\n502 Bad Gateway"), (33, "g", f"{own}\n{foot}")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    found = rows(residue.find_residue(df, broadcast_rows=most))
    assert found == [(30, "error_page"), (31, "placeholder"), (33, "placeholder")]  # 30 only without the line of the host
    assert (30, "error_page") not in rows(residue.find_residue(df, recurrent=10**9))
    large = [(i, "h", f"{own.format('x' * i)}\nДобрый день, {{{{ user_name }}}}!" if i < 6 else own.format("y" * i)) for i in range(400)]
    assert len(rows(residue.find_residue(spark.createDataFrame(large, "doc_id long, source string, text string"), broadcast_rows=most))) == 6  # six of 400 are no boilerplate


@pytest.mark.parametrize(
    "text,want",
    [
        ("тест тест тест тест", ["filler"]), ("asdf qwerty jkl zxcvbn", ["filler"]), ("йцукен фыва олдж", ["filler"]), ("blah blah blah blah blah", ["filler"]), ("We were there", []), ("Да, да, да!", []), ("Купили удочки вчера. Купили удочки сегодня.", []),
        ("Ресурс не найден (код 410). Вернитесь назад.", ["error_page"]), ("The server encountered an internal error and was unable to complete your request.", ["error_page"]), ("У меня страница не найдена, ошибка 404, что делать?", []),
        ("This website requires JavaScript to be enabled in your browser.", ["script_notice"]), ("Я отключил JavaScript, сайт не работает.", []), ("[YOUR NAME HERE] writes", ["placeholder"]), ("{% if user %}Hi{% endif %}", ["placeholder"]), ("См. пункт [2] и [a](http://b.test)", []), ("```\nprint({name})\n```", []),
    ],
)
def test_residue_by_kinds_of_words(text, want):
    assert residue.residue_types(text) == want


def test_copies_of_a_post_and_repeats_inside_it_are_no_boilerplate(spark):
    post = "Сервис временно недоступен, попробуйте через 5 минут.\nСосед хвалит дрели, а я выбираю обои для кухни и коридора, потом поеду на дачу красить забор."
    data = [(i, "h", post) for i in range(9)] + [(20, "g", "\n".join([post] * 9))]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    assert rows(residue.find_residue(df)) == []


def test_labelled_texts_are_bounded(small):
    assert len(abuse.labelled_texts(small, 10)) <= 10 and all(y in (0, 1) and n >= 1 for _, y, n in abuse.labelled_texts(small))


def test_no_word_of_the_corpus_is_lost_without_markup():
    assert markup.to_plain(LONG, markup.markup_types(LONG)) == LONG and not re.search("<", markup.to_plain("<b>x</b>", ["html"]))
