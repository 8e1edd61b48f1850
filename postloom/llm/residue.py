"""Template residue and error-page text.

Normalised lines are counted by the distinct texts of a host that hold them. Lines that recur there are boilerplate and are
subtracted, so only the residual of a record is judged. An unfilled field counts anywhere in it. Filler, error messages
and script notices count when they stand in place of content: when a sentence carries their evidence and next to nothing
else is said. A record of which nothing is left is boilerplate through and through; then the boilerplate with evidence is
what it says.

Evidence is made of kinds of words, not of known sentences: what is spoken of (a page, a server, a script, a text), what
is said of it (not found, must be enabled, goes here) and what to do about it, with status codes, the repetition of words
and runs along the rows of a keyboard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.storage import BROADCAST_ROWS, cut, fits_broadcast, spread

#: Distinct texts of a host that share a line before it counts as boilerplate, and their least share of the host's texts.
RECURRENT, SHARE = 5, 0.02
#: Words besides the evidence up to which it still stands in place of content.
SPARE_WORDS = 6
#: Other words that a sentence may hold for each of its words with evidence.
OTHERS = 0.5
#: Words of a window in which repetition is measured, distinct words up to which a window is repetition, their share at
#: most, and words from which that is measured. A text of more than FEW_SMALL words without one small word is no language
#: if it draws on few words: up to a share of LITTLE distinct ones.
WINDOW, DISTINCT, HALF, FEWEST, LITTLE, FEW_SMALL = 20, 4, 0.5, 4, 0.75, 20
#: Share of words that run along the keyboard, and of a word's steps, from which they count.
RUNS, STEPS = 0.6, 0.75

# Forms of unfilled fields; NAME stands for an identifier, LABEL for words in capitals.
NAME, LABEL = r"[a-zA-Zа-яА-ЯёЁ_][\w.\-]*", r"[A-ZА-ЯЁ][A-ZА-ЯЁ0-9_]*(?:[ _\-][A-ZА-ЯЁ0-9_]+)*"
FIELDS = [
    rf"\{{\{{\{{?\s*[#/^&>]?\s*{NAME}(?:\s*\|\s*{NAME}(?:\s*:[^{{}}\n]*)?)*\s*\}}?\}}\}}(?!\}})",
    rf"\{{%-?\s*\w[^%{{}}\n]{{0,80}}-?%\}}",
    rf"[$#]\{{\s*{NAME}\s*\}}",
    rf"(?<![\w\\^_}}{{$#]){{(?:{NAME}|\d+)}}(?![{{}}])",
    rf"<%=?-?\s*{NAME}[^%<>\n]{{0,60}}%>",
    rf"<\?=?\s*(?:php|echo|\$)[^<>\n]{{0,80}}\?>",
    rf"(?<![\w%])%{LABEL}%(?![\w%])",
    r"(?<![\w%])%(?:\d+\$)?[sd](?![\w%])",
    rf"(?<!\w)__{LABEL}__(?!\w)",
    r"<<\s*\w[\w .\-]{0,40}>>",
    r"@@\w+@@",
    r"(?<![\w#])#[A-ZА-ЯЁ_]{3,}#(?![\w#])",
    r"(?<![\w|])\|{2,3}[A-ZА-ЯЁ_]{3,}\|{2,3}(?![\w|])",
    r"\*\|[A-ZА-ЯЁ_:]{2,}\|\*",
    rf"\[(?:{LABEL.replace('0-9_]*', '0-9_]+', 1)})\](?![(\[])(?<=[A-ZА-ЯЁ_]{{3}}\])",
    r"\[(?i:insert|add|enter|your|put|type|fill|вставьте|вставить|вставь|укажите|указать|введите|ввести|ваше?|ваша|впишите|вписать|заполните)\b[^\[\]\n]{1,60}\](?!\()",
    r"<(?i:your|insert|enter|ваше?|ваша|укажите|введите|вставьте)[ _\-][^<>\n=]{1,60}>",
]
# Beginnings of words of a sentence that speaks of templates or code instead of being left over from one.
TALK = "шаблониз шаблон templat синтакс syntax переменн variable плейсхолдер placeholder jinja mustache f-строк f-string".split()
TALK_PHRASES = r"\bprint\s*\(|\bf['\"]|\bformat\s*\(|you write|(?:пиш|напис)\w*\s+(?:как|так)|\bin my (?:script|code)\b|в (?:моём |моем )?(?:скрипте|коде)\b|`[^`\n]*$"
# Beginnings of words by what they say. "what" is spoken of, "said" of it, "do" follows from it.
CUES = {
    "error_page": {
        "what": "page страниц site сайт server сервер service сервис resource ресурс request запрос access доступ connect соедин подключ database баз session сесси thread тем topic url адрес link ссылк gateway шлюз host хост proxy прокси side сторон forum форум account аккаунт",
        "said": "error ошибк found найден unavailable недоступ denied запрещ закрыт forbidden exist существу expired истек истёк deleted removed удален удалён удалена failed fail сбой wrong bad timeout timed many слишком oops упс broken internal внутренн unauthori unable cannot could не_удалось удалось пошло maintenance обслуживан overload перегруж refused lost",
        "do": "try попроб again снова retry refresh обнов reload перезагр later позже wait подожд contact обрат admin админ support поддержк back верн home главн login log sign войд войти регистрац register reference код code id request moment минут секунд minute second sorry извин простит moved перемещ requested запрош looking return перейд temporarily временно nginx apache cloudflare status статус reported сообщ something went что-то happened",
    },
    "script_notice": {
        "what": "javascript js скрипт сценари script cookie куки кук browser браузер",
        "said": "enable включ turn allow разреш require требу need нуж disabl отключ without без support поддерж check провер must выполнен run work работа blocked заблокир activate актив",
        "do": "continue продолж page страниц site сайт app приложен forum форум please пожалуйста refresh обнов reload перезагр settings настройк file файл load загру loading seconds секунд wait подожд before перед enter вход войд view просмотр left остал use использ file файл safe безопас correct коррект properly noscript займет займёт take moment",
    },
    "filler": {
        "what": "text текст copy content контент содержим article стать post пост description описан headline заголов title назван body paragraph абзац lorem ipsum рыба рыбн",
        "said": "here здесь тут goes будет placeholder заглушк dummy sample filler заполнит тестов test тест пример образец example replace замен insert встав lorem ipsum рыбн рыба должен coming скоро появ",
        "do": "later позже layout вёрстк верстк check провер page страниц your ваш this этот block блок simply just",
    },
}
# Marks of one who speaks of an error instead of a page that shows it.
PERSON = "я меня мне мной мой моя моё мое мои моего моей моём моем моих мою i me my mine i'm i've подскажите посоветуйте помогите кто who anyone advise вчера yesterday".split()
# Small words that say nothing.
SMALL = (
    "the a an of to in on at for and or but is are was were be been has have had it its this that these those you your we our us not no do does did can will with from by as if so then too please all any "
    "и в во на не но а или из за по при к с со у о об до для от это эта этот эти то так вы вас вам ваш ваша ваше вашем вашей мы нас нам наш наша нашей нашем есть был была было были уже ещё еще если как что он она оно они бы же ли нет да пожалуйста чтобы хотя пока когда потому где там все всё который сначала только"
).split()
# Rows of keyboards.
ROWS = "qwertyuiop asdfghjkl zxcvbnm 1234567890 йцукенгшщзхъ фывапролджэ ячсмитьбю".split()

_FIELD = re.compile("|".join(FIELDS))
_TALK = re.compile(TALK_PHRASES + "|" + "|".join(rf"(?<!\w){w}" for w in TALK), re.I)
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(code|pre)\b.*?</\1>|\$[^$\n]*[\\^_][^$\n]*\$|\\\[.*?\\\]", re.S | re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CODED = re.compile(r"[`<$\\]")
_STATUS = re.compile(r"(?<![\d.,])[45]\d\d(?![\d.,]*\d)")
_STEMS = {kind: {role: tuple(sorted(set(x.replace("ё", "е").split()))) for role, x in roles.items()} for kind, roles in CUES.items()}
_SMALL, _PERSON = frozenset(w.replace("ё", "е") for w in SMALL), frozenset(w.replace("ё", "е") for w in PERSON)
_NEAR = {a + b for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x), (x, x), (y, y))}
_STRONG = ("oops", "упс", "forbidden", "error", "ошибк", "lorem", "ipsum", "заглушк", "placeholder")


@lru_cache(1 << 16)
def _roles(word: str) -> frozenset[tuple[str, str]]:
    """What a word says, by type; long stems are known with a slip of the pen."""
    said = frozenset((kind, role) for kind, roles in _STEMS.items() for role, stems in roles.items() if any(word == s or len(s) > 2 and word.startswith(s) for s in stems))
    return said or frozenset((kind, role) for kind, roles in _STEMS.items() for role, stems in roles.items() if any(len(s) > 6 and _begins(word, s) for s in stems))


def _begins(word: str, stem: str) -> bool:
    """Whether a word begins with a stem but for one letter changed, dropped, added or swapped with the next."""
    k = next((i for i, (x, y) in enumerate(zip(word, stem, strict=False)) if x != y), len(word))
    a, b = word[k:], stem[k:]
    return a[1:].startswith(b[1:]) or a.startswith(b[1:]) or a[1:].startswith(b) or a[:2] == b[1::-1] and a[2:].startswith(b[2:])


def words_of(text: str) -> list[str]:
    """Words in lower case; numbers and codes, in which digits stand, are none."""
    return [w for w in _WORD.findall(text.lower().replace("ё", "е")) if w.isalpha() or not any(c.isdigit() for c in w)]


@lru_cache(1 << 16)
def _on_keyboard(word: str) -> bool:
    return len(word) > 2 and sum(word[i : i + 2] in _NEAR for i in range(len(word) - 1)) >= STEPS * (len(word) - 1)


def is_noise(words: list[str]) -> bool:
    """Whether a text says nothing at all: a few words over and over, or runs along the keyboard."""
    if not words:
        return False
    runs = sum(map(_on_keyboard, words))
    if runs >= RUNS * len(words) and (len(words) > 1 or len(words[0]) > 5):
        return True
    if len(words) < FEWEST:
        return False
    parts = [words[k : k + WINDOW] for k in range(0, len(words), WINDOW)]
    if len(parts) > 1 and len(parts[-1]) < WINDOW // 2:
        parts.pop()
    distinct = [len(set(p)) for p in parts]
    if all(n <= DISTINCT and n <= HALF * len(p) for n, p in zip(distinct, parts, strict=True)):
        return True
    return len(words) > FEW_SMALL and _SMALL.isdisjoint(words) and sum(n / len(p) for n, p in zip(distinct, parts, strict=True)) <= LITTLE * len(parts)


def _pseudo_latin(words: list[str]) -> bool:
    """A sentence in Latin letters without one small word of English."""
    return bool(words) and all(w.isascii() for w in words) and not any(w in _SMALL for w in words)


def evidence(sentence: str) -> tuple[str | None, int]:
    """The type that a sentence is evidence for, and its words that say something else."""
    words = words_of(sentence)
    said = [w for w in words if w not in _SMALL]
    if _PERSON.intersection(words) or sentence.rstrip().endswith("?"):
        return None, len(said)
    best, fewest = None, len(said)
    for kind in CUES:
        roles = [{r for k, r in _roles(w) if k == kind} for w in said]
        what, telling = any("what" in r for r in roles), any("said" in r for r in roles)
        code = kind == "error_page" and _STATUS.search(sentence) is not None
        strong = any(w.startswith(_STRONG) for w, r in zip(said, roles, strict=True) if "said" in r)
        others = sum(not r for r in roles)
        two = sum(bool(r & {"what", "said"}) for r in roles) > 1
        if ((what and telling and two) or (code and (what or telling)) or (strong and others == 0)) and others <= OTHERS * (len(said) - others):
            if best is None or others < fewest:
                best, fewest = kind, others
    if best is None and said and min(sum(all(k != kind for k, _ in _roles(w)) for w in said) for kind in CUES) == 0:
        return None, 0  # what goes with such pages
    return best, fewest


def placeholders(text: str) -> bool:
    """Whether an unfilled field is left in a text; those in code, in formulas and in talk of templates are not."""
    if not _FIELD.search(text):
        return False
    for s in _SENTENCE.split(_CODE.sub(" ", text)):
        if _FIELD.search(s) and not _TALK.search(s):
            return True
    return False


def page_types(text: str) -> set[str]:
    """Types of evidence that stands in place of content in a residual."""
    plain = _TAG.sub(" ", _CODE.sub(" ", text)) if _CODED.search(text) else text
    if is_noise(words_of(plain)):
        return {"filler"}
    found: set[str] = set()
    spare, lorem = 0, False
    for s in _SENTENCE.split(plain):
        if not s.strip():
            continue
        own = words_of(s)
        kind, other = evidence(s)
        lorem = lorem or "lorem" in own and "ipsum" in own
        if lorem and (kind == "filler" or _pseudo_latin(own)):
            found.add("filler")
            continue
        if kind:
            found.add(kind)
        spare += other
        if spare > SPARE_WORDS:
            return set()
    return found


def judged(text: str) -> set[str]:
    """Types of a residual. One with an unfilled field is a form, whose sentences stand for no page."""
    return {"placeholder"} if placeholders(text) else page_types(text)


def residue_types(text: str, boilerplate: set[int] = frozenset()) -> list[str]:
    """Types of residue in a text whose lines at the positions ``boilerplate`` recur at its host; sorted."""
    if not boilerplate:
        return sorted(judged(text))
    lines = text.split("\n")
    left = "\n".join(x for k, x in enumerate(lines) if k not in boilerplate)
    if words_of(left):
        return sorted(judged(left))
    return sorted(set().union(*(judged(lines[k]) for k in boilerplate)))  # nothing is left: the boilerplate is all it says


def _norm(line):
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[0-9a-f]*\d[0-9a-f]*", "0"), r"\s+", " ")


def find_residue(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", recurrent: int = RECURRENT, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, residue_type), one row a type found.

    A NULL host is a host of its own. NULL, empty and blank texts have no residue. Repeated rows of an id count once in
    the result. A line recurs by the distinct texts of its host that hold it, at least ``recurrent`` and a ``share`` of
    all of them, so neither copies of a post nor a large host make its sentences boilerplate. Each text's lines are
    counted once and pre-aggregated before the shuffle; texts are never cut or sampled. A host has at most (lines a text)
    / ``share`` recurrent lines; while all of them fit a broadcast, texts do not move at all, else only positions of
    recurrent lines travel to them.
    """
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), F.col(text).alias("_text"))
    key = lambda line: F.xxhash64(_norm(line))
    keys = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""), key))
    lines = rows.select("_host", F.xxhash64("_text").alias("_copy"), F.explode(F.concat(keys, F.array(F.lit(None).cast("long")))).alias("_key"))  # NULL stands for the text
    counts = lines.groupBy("_host", "_key", "_copy").agg(F.lit(1)).groupBy("_host", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") >= recurrent)
    counts = cut(counts, "lines")  # texts are read once for all that follows from the counts
    total = counts.filter(F.col("_key").isNull()).select(F.col("_host").alias("_h"), F.col("_n").alias("_all"))
    common = counts.filter(F.col("_key").isNotNull()).join(total, F.col("_host") == F.col("_h")).filter(F.col("_n") >= share * F.col("_all")).select("_host", "_key")
    if fits_broadcast(common, broadcast_rows):
        known = common.groupBy("_host").agg(F.collect_list("_key").alias("_keys"))
        judged = spread(rows).join(F.broadcast(known), "_host", "left")
        marks = F.transform(F.split("_text", "\n"), lambda x: F.array_contains("_keys", key(x)))
        judged = judged.select("doc_id", "_text", F.when(F.col("_keys").isNotNull(), marks).alias("_marks"))
    else:
        at = rows.select("doc_id", "_host", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).select("doc_id", "_host", "_pos", key(F.col("_line")).alias("_key"))
        marked = at.join(common, ["_host", "_key"]).groupBy("doc_id").agg(F.collect_set("_pos").alias("_at"))
        judged = rows.join(marked, "doc_id", "left")
        marks = F.transform(F.sequence(F.lit(0), F.size(F.split("_text", "\n")) - 1), lambda k: F.array_contains("_at", k))
        judged = judged.select("doc_id", "_text", F.when(F.col("_at").isNotNull(), marks).alias("_marks"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, t) for i, text, marks in zip(pdf["doc_id"], pdf["_text"], pdf["_marks"], strict=True) for t in residue_types(text, {k for k, x in enumerate(marks) if x} if marks is not None else set())]
            yield pd.DataFrame(out, columns=["doc_id", "residue_type"])

    return judged.mapInPandas(judge, "doc_id long, residue_type string").distinct()


def without_residue(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the records that ``found`` names."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
