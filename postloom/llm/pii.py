"""Personal information inside free text: a semi-Markov conditional random field over typed segments.

A text is segmented into single tokens outside any entity and bounded entity segments of at most ``MOST_TOKENS``.
Candidate segments are those whose form can be one of the types at all: digit runs, an address word or a name with a house
number, two words in the spelling of proper names, initials, a given name with another word in any spelling. Features look
at the whole span (its mask, digits, length, case, script, endings, completeness) and at the words around it; given names
that are known are one feature among others. Dynamic programming over token positions
chooses boundaries and types jointly. Weights are fitted by gradient ascent on the likelihood (forward-backward over the
same lattice) on generated sentences, see ``pii_corpus``; ``python -m postloom.llm.pii`` fits and stores them.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.pii_names import COMMON, given_forms
from postloom.storage import spread

TYPES = ("email", "phone", "id_number", "address", "person")
#: Tokens of an entity at most.
MOST_TOKENS = 40
WEIGHTS = Path(__file__).parent / "weights" / "pii_semicrf.json"

# Beginnings of words that hint at a type before or after a span.
CUES = {
    "phone": "тел звон моб номер вайбер ватсап факс набер phone tel call mobile cell number ring fax sms whatsapp dial",
    "id": "паспорт снилс инн прав удостов водит п/с серия код полис данные documents ssn social security passport licence license national id identity card insurance tax tin nino driver driving физлица",
    "goods": "заказ артикул трек isbn верс version роутер router координат order part parcel track sku serial invoice чек счет счёт цена paid price купил модел model item товар build накладн бронь booking ticket билет",
    "address": "адрес живу забир шлите достав пишите address live ship pick mail deliver send come находим",
    "person": "врач отвечал справк выдал оформил запис деньги отдал привет передайте продав зовут хозя мастер акте dr mr mrs ms prof signed ask belongs seller regards sincerely called named господин гражд директор менеджер подпис фио сотрудни written met known",
    "mail": "почт ящик пишите контакт email mail inbox write contact reach прайс prices",
}
# Words of street addresses.
STREET_RU = "ул|улица|улице|улицы|просп|проспект|пр-т|пр-кт|пер|переулок|наб|набережная|шоссе|ш|бульвар|б-р|пл|площадь|проезд|тупик|аллея"
STREET_EN = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|terrace|boulevard|blvd|square|crescent"
# Digits in words.
DIGITS = "ноль нуль один одна два две три четыре пять шесть семь восемь девять плюс zero oh one two three four five six seven eight nine double plus"
# Words that follow or precede a given name without being a surname.
PLAIN = (
    "says said is was and or so does has had will can did likes asked told wrote thinks from with the a an in on at to for of but then too thanks hi hello dear spouse yes no well anyway folks update please also just here there my our your his her "
    "спасибо привет здравствуйте и а но как опять снова сказал сказала права прав пишет советует из от на в с у для не ну да нет это тоже был была друзья ребята кстати апдейт где кто что мой моя наш"
)

_DIGIT = "|".join(sorted(DIGITS.split(), key=len, reverse=True))
_TAIL = r"(?:[.,]?\s*(?:дом|д\.?)?\s*№?\s*\d+(?:\s?[а-г](?![а-яё]))?(?![\d])(?:\s?[/-]\s?\d+)?(?:,?\s*(?:корп|к|стр)\.?\s*\d+)?(?:,?\s*(?:кв|квартира|оф|офис)\.?\s*\d+)?)"
_HEAD = r"(?:\d{6},\s*)?(?:(?:г\.|город|гор\.|пос\.|с\.)\s*)?(?:[А-ЯЁа-яё-]{3,}(?:\s[А-ЯЁа-яё-]{3,})?,\s*)?"
_NAME_RU = r"[А-ЯЁа-яё][а-яёА-ЯЁ-]{2,}(?:\s[А-ЯЁа-яё][а-яёА-ЯЁ-]{2,}){0,2}"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|собака|эт|dog)\s?[\])}]\s?|\s(?:собака|эт)\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|точка)\s?[\])}]\s?|\s(?:dot|точка)\s)"
_SAID = r"(?:\s?[\[({]\s?(?:dot|точка)\s?[\])}]\s?|\s(?:dot|точка)\s)"
_FLAT = r"(?<!\w)(?:(?:flat|apt|apartment|unit|suite)\.?\s?\d+\w?,?\s)?(?:no\.?\s?)?\d+\s?[a-z]?,?\s(?:[a-z'-]+\s){1,3}"
_BOX = r"(?<!\w)(?:p\.?\s?o\.?\s?box|post(?:al)? box|а/я|абонентский ящик|почтовый ящик)\s?№?\s?\d+"
_TOWN = r",\s[^\W\d_][\w-]+(?:\s(?-i:[A-ZА-ЯЁ])[\w-]+)?(?:\s\d{5,6})?"
_BARE = r"[А-ЯЁ][а-яё-]{3,}(?:[ ][А-ЯЁ][а-яё-]{2,})?,?[ ](?:д\.?[ ]?|дом[ ])?\d{1,3}(?:[ ]?[а-г](?![а-яё]))?(?:[/-]\d{1,3})?"
_I = re.I
PATTERNS = [
    (("email",), re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", _I)),
    (("email",), re.compile(rf"(?<![\w.+-])[\w][\w.+-]*\sat\s[\w-]+(?:{_SAID}[\w-]+)+", _I)),
    (("phone", "id_number"), re.compile(r"(?<![\w.+(/-])(?:\+\s?)?\(?\d(?:[\s().–-]{0,3}\d){5,15}(?:\s?\(?(?:код|code)\s?\d{2,5}\)?)?(?![\d])", _I)),
    (("phone", "id_number"), re.compile(rf"(?<!\w)(?:(?:{_DIGIT}|\d)[\s,.-]+){{5,18}}(?:{_DIGIT}|\d)(?!\w)", _I)),
    (("id_number",), re.compile(r"(?<![\w-])[A-ZА-Я]{1,2}[\s-]?\d(?:[\s-]?\d){5,13}(?:\s?[A-ZА-Я])?(?!\w)", _I)),
    (("id_number",), re.compile(r"(?<![\w-])\d(?:[\s№-]{0,4}\d){5,13}(?:,\s?код\s\d{3}-\d{3})?(?!\d)", _I)),
    (("address",), re.compile(rf"(?<!\w){_HEAD}(?:{STREET_RU})\.?\s{_NAME_RU}{_TAIL}", _I)),
    (("address",), re.compile(rf"(?<!\w)(?:{STREET_RU})\.?\s{_NAME_RU}{_TAIL}", _I)),
    (("address",), re.compile(rf"(?<!\w){_HEAD}{_NAME_RU}\s(?:{STREET_RU})\.?{_TAIL}", _I)),
    (("address",), re.compile(_FLAT + rf"(?:(?:st|rd|ln|ave|dr)\.|(?:{STREET_EN})(?!\w))(?:,?\s(?:flat|apt|apartment|unit)\.?\s?\d+\w?)?", _I)),
    (("address",), re.compile(_FLAT + rf"(?:(?:st|rd|ln|ave|dr)\.|(?:{STREET_EN})(?!\w))(?:,?\s(?:flat|apt|apartment|unit)\.?\s?\d+\w?)?{_TOWN}", _I)),
    (("address",), re.compile(rf"(?<![\w-])(?:(?<=\bна )|(?<=\bпо )|(?<=\bу )){_BARE}(?![\w/-]|[.,]\d|\s\d)")),
    (("address",), re.compile(rf"(?<![\w-]){_BARE},?\s(?:кв|квартира|оф|офис|корп|стр)\.?\s?\d+(?![\w/-]|[.,]\d)")),
    (("address",), re.compile(_BOX, _I)),
    (("address",), re.compile(_BOX + _TOWN, _I)),
]
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|\d+|[^\w\s]")
_NAME = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_INITIALS = re.compile(r"(?<!\w)[А-ЯЁA-Z]\.(?:\s?[А-ЯЁA-Z]\.)?(?!\w\.)", _I)
_PATRON = re.compile(r"(?:(?:ов|ев)(?:ич(?:а|у|ем|е)?|н(?:а|ы|е|у|ой))|иничн(?:а|ы|е|у|ой)|ильич(?:а|у|ом|е)?|кузьмич\w{0,2}|лукич\w{0,2}|фомич\w{0,2})$")
_SURNAME = re.compile(r"(?:(?:ов|ев|ёв|ин|ын)(?:а|у|ы|ым|е|ой|ом)?|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)|енко|ук|юк|як)$")
# What a text must hold for each pattern to match anywhere in it.
_GATES = [
    re.compile(_AT, _I), re.compile(rf"\sat\s.*?{_SAID}", _I), re.compile(r"\d"), re.compile(rf"(?<!\w)(?:{_DIGIT}|\d)[\s,.-]+(?:{_DIGIT}|\d)[\s,.-]+(?:{_DIGIT}|\d)(?!\w)", _I), re.compile(r"\d"), re.compile(r"\d"),
    *[re.compile(rf"(?<!\w)(?:{STREET_RU})(?!\w)", _I)] * 3, *[re.compile(rf"(?<!\w)(?:{STREET_EN})(?!\w)", _I)] * 2, *[re.compile(_BARE)] * 2, *[re.compile(r"box|а/я|ящик", _I)] * 2,
]
_LETTERS = re.compile(r"[^\W\d_]+")
# Two or three words in the spelling of proper names, of one script.
_PROPER = re.compile(r"(?<![\w'’-])(?=((?:[A-Z][a-z'’]*[a-z](?:-[A-Z]?[a-z]+)*(?:[^\S\n](?:de|da|di|van|von|der|la|el|al|bin|ibn))?[^\S\n][A-Z]['’]?[A-Za-z]*[a-z](?:-[A-Z]?[a-z]+)*|[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)*[^\S\n][А-ЯЁ][а-яё]+(?:-[А-ЯЁ]?[а-яё]+)*(?:[^\S\n][А-ЯЁ][а-яё]+(?:вич|вна|ична|кызы|оглы)[а-яё]{0,2})?)(?![\w'’-])))")
# Beginnings of words beside which two capitalised words name a place, a shop, a work or a brand.
_PLACE = "город г пос село дер район област улиц просп площад станци метро магазин кафе ресторан театр кино фильм роман книг журнал фирм завод отель гостиниц банк клуб форум сайт марк бренд фабрик альбом групп команд парк озер рек гор street road lane avenue drive square park city town village river lake mount hotel cafe bar shop store bakery market cinema theatre theater film movie novel book magazine brand club bank station bridge school college university company ltd inc team band album game county north south east west new old in at near from".split()


@cache
def _stems() -> dict[str, list[str]]:
    return {k: v.split() for k, v in CUES.items()}


@cache
def _plain() -> frozenset[str]:
    return frozenset(PLAIN.split())


@lru_cache(1 << 16)
def _cues_of(word: str) -> tuple[str, ...]:
    return tuple(k for k, stems in _stems().items() if any(word == s or len(s) > 3 and word.startswith(s) for s in stems))


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, form) of every span that whole-span features can describe."""
    out = set()
    digits = _GATES[2].search(text)
    known: dict[int, bool] = {}
    for k, (types, pattern) in enumerate(PATTERNS):
        gate = _GATES[k]
        if id(gate) not in known:
            known[id(gate)] = (digits is not None or k in (0, 1, 3)) and gate.search(text) is not None
        if known[id(gate)]:
            for m in pattern.finditer(text):
                s, e = m.span()
                while e > s and text[e - 1] in " ,–-":
                    e -= 1
                out.update((s, e, t, f"p{k}") for t in types)
    names = given_forms()
    low = text.lower()
    words = [] if names.isdisjoint(_LETTERS.findall(low)) else [(m.start(), m.end(), m[0]) for m in _NAME.finditer(text)]
    for i, (s, e, w) in enumerate(words):
        if w.lower() not in names:
            continue
        def gap(a: int, b: int) -> str | None:
            return text[words[a][1] : words[b][0]] if 0 <= a and b < len(words) else None
        if gap(i, i + 1) == " " or (gap(i, i + 1) or "").isspace() and len(gap(i, i + 1)) < 3 and "\n" not in gap(i, i + 1):
            nxt = words[i + 1]
            middle = _INITIALS.match(text, nxt[0]) if len(nxt[2]) == 1 else None
            if middle and i + 2 < len(words) and text[middle.end() : words[i + 2][0]] == " ":
                out.add((s, words[i + 2][1], "person", "given-initial-last"))
            elif _PATRON.search(nxt[2].lower()):
                if (g := gap(i + 1, i + 2)) is not None and g.isspace() and "\n" not in g:
                    out.add((s, words[i + 2][1], "person", "given-patron-last"))
                if (g := gap(i - 1, i)) is not None and g.isspace() and "\n" not in g:
                    out.add((words[i - 1][0], nxt[1], "person", "last-given-patron"))
                out.add((s, nxt[1], "person", "given-patron"))
            else:
                out.add((s, nxt[1], "person", "given-last"))
        g = gap(i - 1, i)
        if g is not None and (g.isspace() and len(g) < 3 and "\n" not in g):
            out.add((words[i - 1][0], e, "person", "last-given"))
        elif g in (", ", ","):
            out.add((words[i - 1][0], e, "person", "last-comma-given"))
    for m in _INITIALS.finditer(text):
        after = _NAME.match(text, m.end() + (text[m.end() : m.end() + 1] == " "))
        if after and len(after[0]) > 3:
            out.add((m.start(), after.end(), "person", "initials-last"))
        before = re.search(r"[^\W\d_]{4,}(?:-[^\W\d_]+)?\s$", text[max(0, m.start() - 40) : m.start()])
        if before:
            out.add((max(0, m.start() - 40) + before.start(), m.end(), "person", "last-initials"))
    known = {(s, e) for s, e, t, _ in out if t == "person"}
    for m in _PROPER.finditer(text):
        low = {w.lower() for w in _NAME.findall(m[1])}
        if m.span(1) not in known and not low & _plain():
            out.add((*m.span(1), "person", "proper"))
    forms = defaultdict(list)
    for s, e, t, form in sorted(out):
        forms[s, e, t].append(form)
    return [(*span, "+".join(f)) for span, f in sorted(forms.items())]


def features(text: str, span: tuple[int, int, str, str]) -> list[str]:
    """Whole-span and context features of a candidate."""
    s, e, kind, form = span
    body = text[s:e]
    left = [w.lower() for w in _WORD.findall(text[max(0, s - 60) : s])][-6:]
    right = [w.lower() for w in _WORD.findall(text[e : e + 40])][:3]
    cues = {c for w in [x for x in left if len(x) > 1 or x.isalpha()][-4:] for c in _cues_of(w)}
    out = ["bias", f"form={form}"]
    out += [f"cue={c}" for c in cues] or ["cue=none"]
    out += [f"after={c}" for w in right[:2] for c in _cues_of(w) if c in ("goods", "phone")]
    if kind == "person":
        words = _NAME.findall(body)
        names = given_forms()
        rest = [w for w in words if w.lower() not in names and len(w) > 1 and not _PATRON.search(w.lower())]
        last = words[-1] if form == "proper" else rest[0] if rest else words[-1]
        low = last.lower()
        cyr = bool(re.search("[а-яё]", low))
        case = "caps" if body.isupper() else "title" if all(w[:1].isupper() for w in words) else "lower" if body.islower() else "mixed"
        out += [f"case={case}", f"script={cyr}", f"form+case={form},{case}", f"surname={bool(_SURNAME.search(low)) if cyr else 'x'}", f"form+surname={form},{bool(_SURNAME.search(low)) if cyr else case}"]
        given = [w for w in words if w.lower() in names]
        common = bool(given) and all(w.lower() in COMMON.split() for w in given) and "patron" not in form
        out += [f"common={case},{'person' in cues},{bool(_SURNAME.search(low))}"] if common else []
        out += ["plain"] if low in _plain() or len(low) < 4 and form != "proper" else []
        out += ["two-given"] if not rest else []
        out += ["cueword-inside"] if any(_cues_of(w.lower()) for w in rest) else []
        out += [f"shape+cue={form},{'person' in cues}"]
        if form == "proper":
            out += _proper_features(text, s, e, words, left, right, "person" in cues)
        out += ["mixed-script"] if any(bool(re.search("[а-яё]", w.lower())) != cyr for w in words) else []
        return out
    digits = re.sub(r"\D", "", body)
    mask = re.sub(r"[^\W\d_]+", "w", re.sub(r"\d+", lambda m: str(len(m[0])), body))
    if kind in ("phone", "id_number"):
        n = len(digits) + len([w for w in _WORD.findall(body) if w.lower() in DIGITS.split()])
        out += [f"n={min(n, 16)}", f"mask={mask[:24]}", f"first={body[:1] if body[:1] in '+(' else digits[:1]}", f"n+first={min(n, 16)},{body[:1] if body[:1] in '+(' else digits[:1]}"]
        out += [f"cue+n={c},{min(n, 16)}" for c in cues]
        out += ["spelled"] if re.search(r"[^\W\d_]{3,}", body) else []
        out += ["dots"] if re.search(r"\d\.\d+\.\d", body) else []
        out += ["code"] if re.search(r"код|code", body, _I) else []
        return out
    if kind == "address":
        town = re.search(r",\s([^\W\d_])[\w-]*(?:\s[\w-]+)?(?:\s\d{5,6})?$", body)
        out += [f"town={town[1].isupper() if town else 'none'}", f"town+case={town[1].isupper() if town else 'none'},{body.islower()}"]
        out += ["town-plain"] if town and _NAME.search(town[0])[0].lower() in _plain() | {"come", "ring", "заходите", "домофон", "звонок"} else []
        name = re.findall(r"[^\W\d_]{3,}", body)
        out += [f"cap={any(w[0].isupper() for w in name)}", f"tokens={min(len(_WORD.findall(body)), 12)}", f"house={bool(re.search(r'(?:дом|д[.])|no[.]|flat|apt|кв[.]|корп|[/-]', body, _I))}", f"code={bool(re.search(r'(?<!\d)\d{5,6}(?!\d)', body))}"]
        out += ["inner-plain"] if any(w.lower() in _plain() for w in name) else []
        return out
    at = re.search(rf"{_AT}|\sat\s", body, _I)[0].lower()
    out += [f"at={re.sub(r'[^@a-zа-я]', '', at)}", f"dots={min(len(re.findall(_DOT, body, _I)), 4)}", f"tight={' ' not in body}"]
    return out


def _proper_features(text: str, s: int, e: int, words: list[str], left: list[str], right: list[str], cue: bool) -> list[str]:
    """What tells a name nobody has listed from other proper names: its place in the sentence, endings, neighbours."""
    before, after = text[max(0, s - 2) : s].rstrip(" "), text[e : e + 2].lstrip(" ")
    start = not before or before[-1] in ".!?\n…"
    quoted = before[-1:] in ("«", '"', "“", "„") or after[:1] in ("»", '"', "”")
    low = [w.lower() for w in words]
    near = [w for w in left[-2:] + [w for w in right[:1] if len(w) > 3] if w.isalpha()]
    place = any(w == p or len(p) > 3 and w.startswith(p) for w in (*near, *low) for p in _PLACE)
    nxt = right[0] if right else ""
    does = bool(re.search(r"(?:ла?|ли|ет|ит|ают|яет)$", nxt)) or nxt in ("said", "says", "is", "was", "will", "has", "had", "wrote", "told", "did", "can", "came", "called")
    surname = bool(_SURNAME.search(low[-1]) or _SURNAME.search(low[0]))
    return [f"proper:start={start},{cue}", f"proper:quoted={quoted}", f"proper:place={place}", f"proper:does={does},{cue}", f"proper:surname={surname},{start}", f"proper:surname={surname},{cue}", f"proper:place={place},{cue}", f"proper:n={len(words)}"]


class SemiCRF:
    """Weights by type and feature, with inference over the lattice of candidates."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.w: dict[str, dict[str, float]] = {t: defaultdict(float, (weights or {}).get(t, {})) for t in TYPES}

    @classmethod
    @cache
    def stored(cls) -> SemiCRF:
        return cls(json.loads(pkgutil.get_data("postloom.llm", "weights/pii_semicrf.json")))

    def lattice(self, text: str) -> list[tuple[int, int, str, list[str], float]]:
        out = []
        for span in candidates(text):
            if len(_WORD.findall(text[span[0] : span[1]])) > MOST_TOKENS:
                continue
            f = features(text, span)
            w = self.w[span[2]]
            out.append((span[0], span[1], span[2], f, sum(w.get(x, 0.0) for x in f)))
        return out

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation: its entities as (start, end, type). Segments outside entities score 0."""
        spans = [x for x in self.lattice(text) if x[4] > 0]
        if not spans:
            return []
        ends = sorted({x[1] for x in spans})
        by_end = defaultdict(list)
        for x in spans:
            by_end[x[1]].append(x)
        best: list[tuple[float, tuple | None, int]] = [(0.0, None, -1)]  # value, last entity, where it came from
        at = [0]
        for end in ends:
            value, last, prior = best[-1][0], None, len(best) - 1
            for x in by_end[end]:
                k = _before(at, x[0])
                if best[k][0] + x[4] > value + 1e-12:
                    value, last, prior = best[k][0] + x[4], x, k
            best.append((value, last, prior))
            at.append(end)
        out, k = [], len(best) - 1
        while k > 0:
            value, last, prior = best[k]
            if last:
                out.append((last[0], last[1], last[2]))
            k = prior
        return out[::-1]

    def gradient(self, text: str, gold: set[tuple[int, int, str]]) -> tuple[float, dict[tuple[str, str], float]]:
        """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums over the lattice."""
        spans = self.lattice(text)
        points = sorted({0, len(text), *(x[0] for x in spans), *(x[1] for x in spans)})
        where = {p: k for k, p in enumerate(points)}
        n = len(points)
        starts, ends = defaultdict(list), defaultdict(list)
        for x in spans:
            starts[where[x[0]]].append(x)
            ends[where[x[1]]].append(x)
        fwd, bwd = [0.0] * n, [0.0] * n
        for k in range(1, n):
            fwd[k] = _logsum([fwd[k - 1], *(fwd[where[x[0]]] + x[4] for x in ends[k])])
        for k in range(n - 2, -1, -1):
            bwd[k] = _logsum([bwd[k + 1], *(bwd[where[x[1]]] + x[4] for x in starts[k])])
        z, grad, right = fwd[-1], defaultdict(float), 0.0
        for s, e, t, f, score in spans:
            p = math.exp(fwd[where[s]] + score + bwd[where[e]] - z)
            hit = (s, e, t) in gold
            right += score if hit else 0.0
            if abs(hit - p) > 1e-6:
                for x in f:
                    grad[t, x] += hit - p
        return right - z, grad

    def fit(self, data: list[tuple[str, set[tuple[int, int, str]]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> float:
        """Adaptive gradient ascent; gives the mean log-likelihood of the last round."""
        data = [(t, gold) for t, gold in data if gold <= {x[:3] for x in self.lattice(t)}]  # others have no path
        seen: dict[tuple[str, str], float] = defaultdict(float)
        total = 0.0
        for _ in range(rounds):
            total = 0.0
            for text, gold in data:
                like, grad = self.gradient(text, gold)
                total += like
                for (t, x), g in grad.items():
                    g -= decay * self.w[t][x]
                    seen[t, x] += g * g
                    self.w[t][x] += rate * g / math.sqrt(seen[t, x] + 1e-6)
        return total / max(len(data), 1)


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def _before(at: list[int], start: int) -> int:
    """The last lattice point at or before ``start``."""
    lo, hi = 0, len(at)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if at[mid] <= start else (lo, mid)
    return lo - 1


_BLANK = re.compile(r"&nbsp;|&#160;|&#xa0;", re.I)


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """Entities of a text in order; none in NULL and empty texts. Blanks written as entities are read as blanks."""
    if not text:
        return []
    if "&" not in text or not _BLANK.search(text):
        return SemiCRF.stored().decode(text)
    ends, shift = [], 0  # (position after a blank in the read text, characters that it is shorter)
    for m in _BLANK.finditer(text):
        shift += len(m[0]) - 1
        ends.append((m.end() - shift, shift))

    def back(i: int) -> int:
        return i + next((s for e, s in reversed(ends) if e <= i), 0)

    return [(back(s), back(e - 1) + 1, t) for s, e, t in SemiCRF.stored().decode(_BLANK.sub(" ", text))]


def masked(text: str, entities: list[tuple[int, int, str]]) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]``, ... in place of its entities, and every other character as it was."""
    parts, at = [], 0
    for s, e, t in entities:
        parts += [text[at:s], f"[{t.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known: dict[str, tuple[list[str], str]] = {}
        for t in pdf["_text"]:
            if t not in known:
                found = find_entities(t)
                known[t] = (sorted({x[2] for x in found}), masked(t, found))
        yield pd.DataFrame({"rec_id": pdf["rec_id"], "info_types": [known[t][0] for t in pdf["_text"]], "masked": [known[t][1] for t in pdf["_text"]]})


def mask_personal(records: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, info_types, masked) for each row with a text: what it holds and the text with typed placeholders.

    NULL texts and keys are left out; empty texts hold nothing. Rows are handled one by one, so repeated rows come out as
    often as they come in, though equal texts of a batch are read once; long texts are read whole, and no data is moved.
    """
    rows = spread(records.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("_text")))
    return rows.mapInPandas(_each, "rec_id long, info_types array<string>, masked string")


def main() -> None:
    from postloom.llm.pii_corpus import sentences

    model = SemiCRF()
    print("log-likelihood", model.fit(sentences(15000, seed=1), rounds=8))
    held = sentences(2000, seed=2)
    print("exact on held-out sentences", sum(set(model.decode(t)) == g for t, g in held) / len(held))
    WEIGHTS.parent.mkdir(exist_ok=True)
    WEIGHTS.write_text(json.dumps({t: {k: round(v, 4) for k, v in sorted(w.items()) if abs(v) > 1e-3} for t, w in model.w.items()}, ensure_ascii=False, indent=0) + "\n", encoding="utf-8")


if __name__ == "__main__":
    main()
