"""Generated sentences with known entities, on which the personal-information model is fitted.

Sentences are composed from the definitions of the types: a lead, what an entity of the type is said to be, the entity and
a tail. Beside them stand sentences on what is no case: numbers of goods, prices, dates, machines and versions, nicknames,
given names alone, proper names of places, shops and works, streets without a number.
"""

from __future__ import annotations

import random

from postloom.llm.pii_names import EN, RU_MEN, RU_WOMEN

# Syllables and endings of invented names, streets and towns.
SYLLABLES_RU = "аб бак вер гал дар ер жук зуб ибр кам лоб мир ниж орл пав руст саб тим уш фад хас цап шам юс яр бел гур кос мел пол сид".split()
SYLLABLES_EN = "al bran cor dev el fis gra har jen kow lin mor nak ols par quil ragh san tor und var whit xi yam zhan bell hut mac pres stan".split()
ENDS_RU = ("ов", "ев", "ин", "ский", "енко", "ук", "ян", "дзе", "ова-ли", "ко", "ых", "ман", "иди", "ба")
ENDS_EN = ("ley", "ton", "by", "worth", "son", "man", "ski", "ez", "ini", "ari", "unathan", "ang", "ford", "er", "ov", "ic", "sen", "ides", "ura", "well")
GIVEN_RU = "ай ал бах гул дам ди зар ил кам лей мад нур рав рус сал тим фар хал чин эл юл яс".split()
GIVEN_EN = "ah bri car di en fa giu ha in jo ka la mo ni o pri ra sa ta u vi wei xi yu za".split()
ENDS_GIVEN_RU, ENDS_GIVEN_EN = ("ан", "ар", "ат", "ир", "ия", "ик", "ина", "ира", "уль", "ел", "там", "зат"), ("ya", "lia", "med", "na", "ko", "el", "ron", "sh", "ndo", "rik", "ne", "mir", "ta", "vid")
STREETS_RU, STREETS_EN = "Садовая|Лесная|Зелёная|Пушкина|Гагарина|Старых Мастеров|Дальних Гор|Школьная|Кирпичная|Соборная|Новых Садов|Чехова".split("|"), "Orchard|Mill|Old Ferry|Cedar|Long Meadow|Church|Harbour View|Station|Elm|High Bank|King's|Willow".split("|")
BARE_RU = "Ленина Гагарина Пушкина Кирова Мира Чехова Победы Лермонтова Горького Садовой Лесной Школьной".split()
TOWNS_RU, TOWNS_EN = ["Новогорск", "Старые Броды", "Белозёрск", "Дальний Кут", "Приозёрный"], ["Westbrook", "Low Haven", "Northgate", "Port Ellen", "Ashford"]

# Parts of sentences by type. A sentence is a lead, a carrier with {} for the entity, and a tail.
LEADS = {"ru": ["", "", "", "Добрый день! ", "Кстати, ", "если что, ", "Для связи: ", "Всем привет. ", "Напоминаю: ", "и ещё, "], "en": ["", "", "", "Hello! ", "By the way, ", "Just in case, ", "For the record: ", "Hi all. ", "Reminder: ", "oh and "]}
TAILS = {"ru": ["", ".", ".", "!", ", спасибо.", ", жду.", " — и всё.", ", если нужно.", ", только не ночью.", ")", ", вроде так."], "en": ["", ".", ".", "!", ", thanks.", ", please.", " and that is all.", ", if needed.", ", not at night.", ")", ", I think."]}
CARRIERS = {
    ("email", "ru"): "пишите на {}|моя почта {}|почта: {}|адрес электронной почты {}|ответ пришлите на {}|ящик {}|контакт {}|можно написать сюда: {}|счёт отправьте на {}|{} — это мой адрес|отвечаю с {}|резюме на {}|у него почта {}|спросить можно тут: {}".split("|"),
    ("email", "en"): "write to {}|my email is {}|email: {}|mail me at {}|send it to {}|contact {}|the inbox is {}|reach us via {}|forward the bill to {}|{} works best|replies from {}|drop a line to {}|ask {} for the list".split("|"),
    ("phone", "ru"): "звоните {}|мой телефон {}|тел. {}|телефон: {}|номер для связи {}|наберите {}|моб. {}|вайбер {}|ватсап {}|дозвониться можно по {}|{} — звонить после шести|позвони мне на {}|факс {}|пишите в мессенджер {}|контактный номер — {}|мой номер {}".split("|"),
    ("phone", "en"): "call {}|my phone is {}|tel. {}|phone: {}|text me on {}|ring {}|mobile {}|my number is {}|whatsapp {}|you can reach me on {}|{} after six|dial {}|fax {}|leave a message at {}|our office line is {}|cell {}".split("|"),
    ("id_number", "ru"): "паспорт {}|паспорт серии {} утерян|серия и номер паспорта {}|снилс {}|мой снилс {}|инн {}|инн физлица {}|водительское удостоверение {}|права номер {}|полис {}|данные документа {}|удостоверение личности {}|в договоре указан паспорт {}|номер страхового свидетельства {}|п/с {}|номер прав {}".split("|"),
    ("id_number", "en"): "passport {}|passport no. {}|my passport number is {}|ssn {}|social security number {}|tax id {}|national id {}|driving licence {}|driver's license {}|identity card {}|national insurance number {}|her tax number is {}|the id card no {}|insurance number {}|licence {}".split("|"),
    ("address", "ru"): "адрес {}|живу по адресу {}|я живу {}|забирать: {}|доставка на {}|шлите посылку: {}|прописан {}|офис находится: {}|приезжайте на {}|самовывоз, {}|дом стоит: {}|письма на {}|отправьте на {}|наш адрес: {}|мастерская — {}".split("|"),
    ("address", "en"): "my address is {}|i live at {}|address: {}|pick it up at {}|ship to {}|deliver to {}|come to {}|the office is at {}|send the parcel to {}|she moved to {}|collection from {}|mail it to {}|we are at {}|the house is {}".split("|"),
    ("person", "ru"): "врач {} принимает завтра|спросите {}|справку выдал {}|отвечает {}|его зовут {}|мастер {} всё починил|договор подписал {}|директор {}|с уважением, {}|подпись: {}|продавец {}|это {} из соседнего дома|деньги передал {}|привет от {}|менеджер {}|мой сосед {}|{} обещал помочь|записал {}|{} приезжал вчера|акт составила {}|получатель {}|спасибо, {}|работу принял {}|ведёт запись {}".split("|"),
    ("person", "en"): "doctor {} sees patients|ask for {}|signed by {}|the seller was {}|his name is {}|mr {}|mrs {}|dr {}|contact person {}|regards, {}|sincerely, {}|our manager {}|it belongs to {}|written by {}|{} promised to help|i met {} there|my neighbour {}|the form names {}|{} came yesterday|thanks to {}|the payee is {}|call for {}|it was {} who fixed it|known as {}".split("|"),
}
# What is no case; a digit in braces takes as many digits, N a noun, P two capitalised words, G a given name.
NEGATIVE = {
    "ru": "заказ № {4} {6} в пути|номер заказа {8}|артикул {2} {4} {4} {2}|артикул {8}|трек {3}-{3}-{3}|трек-номер {4}{4}{2}|ISBN 978-{1}-{2}-{6}-{1}|роутер на 10.{1}.{1}.{3}|координаты {2}.{4}, {2}.{4}|от 12.0{1}.2025 до 2{1}.11.2025|цена 1 {3} {3} руб|стоит {2} {3} рублей|версия {1}.{1}.{3}|модель {4}-{4}|счёт {4} {4} оплачен|накладная {8}|билет {8}|серийный номер {4} {4} {4}|штрихкод {4}{4}{4}{1}|прошёл {3} {3} км|партия {4}|деталь {3}-{3}-{2}|в магазине P большой выбор N|город P очень красив|смотрели фильм «P»|читаю «P», советую|ездили в P на выходные|бренд P нравится|сайт P закрылся|на улице Садовой было шумно|встретились на Школьной улице|Лесная улица пуста|проспект закрыт на ремонт|мой ник @lis{2}|в игре я fox_{2}|G опять права|G сказала, что N лучше|спасибо, G|привет, G|G и G приехали|N за {2} дней|из {3} человек {2} довольны|в {4} году купил N|размер {2}*{2}*{1} см|серия {1} вышла {2} мая|N на {1} Мая|к 8 Марта {2} подарков|глава {2} и пункт {1}|Марта {2} числа|в Старых Бродах {2} магазинов|купили N вчера|какие N лучше|советую N|кто пробовал N|у N хорошая цена".split("|"),
    "en": "order no. {4} {6} is late|order {8}|part {2} {4} {4} {2}|item {8}|parcel {3}-{3}-{3}|tracking {4}{4}{2}|ISBN 978-{1}-{2}-{6}-{1}|router at 10.{1}.{1}.{3}|position {2}.{4}, {2}.{4}|from 0{1}/12/2025 to 1{1}/12/2025|costs 1,{3},{3}|paid {2},{3} in cash|version {1}.{1}.{3}|model {4}-{4}|invoice {4} {6}|ticket {8}|serial {4} {4} {4}|barcode {4}{4}{4}{1}|drove {3},{3} miles|batch {4}|the P shop has many N|the town of P is lovely|we watched P last night|reading P, good book|a trip to P for the weekend|the P brand is fine|P Hotel was full|Orchard Street was busy|met at Mill Lane, nice|Cedar Road is closed|my nick is @fox{2}|in the game i am wolf_{2}|G was right again|G said that N are better|thanks, G|hi, G|G and G came|N in {2} days|delivery took {2} days and the N arrived|{2} days, the N were fine|{2} of {3} people like N|in {4} i bought N|size {2} x {2} x {1} cm|chapter {2} of P|on May {2}|we bought N late|which N are best|try N|who tested N|N are cheap|March {2}|platform {1} at {2}:30".split("|"),
}
NOUNS = {"ru": "розы|семена|книги|романы|марки|лампы|чехлы|насосы|удочки|пироги|яблоки|щётки|краски|ковры|дрели|обои|кастрюли|билеты|роза садов|марка телефонов|вера в себя|любовь к кино|роман о море|надежда городов".split("|"), "en": "roses|seeds|books|novels|stamps|lamps|cases|pumps|rods|pies|apples|brushes|paints|rugs|drills|tickets|rose gardens|violet curtains|jack handles|bill payments|mark sheets|ivy leaves|frank talks|grace notes|will forms|road maps|street lamps|court shoes|drive belts|lane markers|square plates".split("|")}
PLACES = {"ru": "Добрый Дом|Старые Броды|Новый Свет|Красная Площадь|Северный Ветер|Дальний Кут|Тихая Гавань|Белые Ночи|Золотой Ключ|Зимний Сад|Первый Канал|Новый Год|Великий Новгород|Чёрное Море".split("|"), "en": "River Town|Golden Gate|Low Haven|Silver Moon|Port Ellen|Old Oak|Green Valley|Lost Highway|New Dawn|Blue Harbour|Royal Mail|Black Friday|Winter Garden|High Bank".split("|")}
# Words that open a sentence or a heading, and what may follow a made-up word there.
OPENERS = {"ru": "Вчера Сегодня Наконец Снова Хвалю Беру Держу Продаю Ищу Обзор Мнение Ответ Вопрос Плюсы Минусы Итоги Итог Важно Отзыв Опыт Совет Новости Раньше Теперь Осенью Советую Читаю Сравнил Сосед Доставка Кто Где Без".split(), "en": "Yesterday Today Finally Again Review Opinion Answer Question Pros Cons Summary Verdict Update Overall Advice News Later Now Delivery Selling Compare Reading Neighbour Who Where Without Important".split()}
AFTER = {"ru": "удивил всех|подорожал|радует|лучше прочих|дома нет|хвалит друзей|при каждом случае|нравится|сломался|и всё".split("|"), "en": "surprised us|got dearer|is fine|beats the rest|arrived whole|broke again|at every turn|and so on|was late".split("|")}
WORDS = {"ru": "ноль один два три четыре пять шесть семь восемь девять".split(), "en": "zero one two three four five six seven eight nine".split()}


def _digits(r: random.Random, mask: str) -> str:
    return "".join(r.choice("0123456789") if c == "d" else c for c in mask)


def _surname(r: random.Random, ru: bool) -> str:
    parts, ends = (SYLLABLES_RU, ENDS_RU) if ru else (SYLLABLES_EN, ENDS_EN)
    return ("".join(r.sample(parts, r.choice([1, 2]))) + r.choice(ends)).title()


def _given(r: random.Random, ru: bool, cased: bool) -> tuple[str, bool]:
    """A given name, known or (in texts with capitals) not, and whether it is a woman's."""
    if cased and r.random() < 0.5:
        parts, ends = (GIVEN_RU, ENDS_GIVEN_RU) if ru else (GIVEN_EN, ENDS_GIVEN_EN)
        name = (r.choice(parts) + r.choice(ends)).capitalize()
        return name, name[-1] in "аяь"
    woman = r.random() < 0.5
    return r.choice((EN if not ru else RU_WOMEN if woman else RU_MEN).split()).capitalize(), woman


def _email(r: random.Random, ru: bool) -> str:
    user = r.choice(["ivan", "sales.team", "info_7", "fox-12", "cat.lover", "nora+5", "почта", "shop", "k.petrov", "hello", "office"]) + r.choice(["", str(r.randint(1, 999)), "-x"])
    host = r.choice(["mail.test", "mx.post.example", "uni-town.test", "corner.invalid", "лавка.test", "a-b.example", "box.example"])
    at = r.choice(["@"] * 6 + [" @ ", " (at) ", "[собака]", " собака ", "[at]", " [at] ", " at "])
    said = at not in ("@", " @ ", "[собака]", "[at]")
    dots = r.choice([" (dot) ", " точка ", " dot ", "[dot]"]) if said and (at == " at " or r.random() < 0.7) else "."
    out = user + at + host.replace(".", dots)
    return out.upper() if r.random() < 0.08 else out


def _phone(r: random.Random, ru: bool) -> str:
    if r.random() < 0.16:
        w = WORDS["ru" if ru else "en"]
        return " ".join(r.choice(w) for _ in range(r.choice([10, 11])))
    masks = (
        ["+7ddddddddddd"[:12], "+7 (ddd) ddd-dd-dd", "8-ddd-ddd-dd-dd", "8 ddd ddd dd dd", "+7 ddd ddd dd dd", "8(ddd)ddddddd", "8(ddd)ddd-dd-dd", "+7.ddd.ddd.dd.dd", "ddd-dd-dd (код ddd)", "8 (ddd) ddd dd dd", "8ddddddddddd"[:11], "7ddddddddddd"[:11], "+7-ddd-ddd-dd-dd"] if ru
        else ["+44 dddd dddddd", "+44ddddddddddd"[:13], "(ddd) ddd-dddd", "ddd.ddd.dddd", "ddd-ddd-dddd", "+1.ddd.ddd.dddd", "001-ddd-ddd-dddd", "0dddd ddd ddd", "0dddd dddddd", "+1 ddd ddd dddd", "+1 (ddd) ddd-dddd", "ddd ddd dddd"]
    )
    return _digits(r, r.choice(masks))


def _id(r: random.Random, ru: bool) -> str:
    masks = ["dd dd dddddd", "dddd № dddddd", "dddd dddddd", "ddd-ddd-ddd dd", "ddddddddddd", "dddddddddddd", "dddd dddddd, код ddd-ddd"] if ru else ["ddd-dd-dddd", "ddd dd dddd", "ddddddddd", "Xdddddddd", "Dddd-dddd-dddd", "QQ dd dd dd C", "dddddddddd", "AB dddddd C", "N ddddddd", "ZZ dd dd dd Q"]
    mask = r.choice(masks)
    if r.random() < 0.4:
        mask = mask.replace("dd", "00", 1)
    return mask[0] + _digits(r, mask[1:]) if mask[0] == "D" else _digits(r, mask)


def _address(r: random.Random, ru: bool) -> str:
    n, m = str(r.randint(1, 190)), str(r.randint(1, 99))
    if ru:
        s, town, b = r.choice(STREETS_RU), r.choice(TOWNS_RU), r.choice(BARE_RU)
        return r.choice([
            f"ул. {s}, д. {n}, кв. {m}", f"г. {town}, ул. {s}, {n}-{m}", f"улица {s} дом {n}", f"пер. {s} {n}/{m}", f"{town}, пр-т {s}, {n} корп. {m}", f"00{r.randint(1000, 9999)}, г. {town}, {s} наб., д.{n}", f"{town}, {s} наб., д.{n}", f"проспект {s}, {n}", f"ул {s} {n}",
            f"а/я {n}, {town}", f"{s} улица, дом {n}", f"шоссе {s}, д. {n}", f"{b} {n}, кв {m}", f"{b} {n}, кв. {m}", f"{b}, {n}, корп. {m}",
        ])
    s, town = r.choice(STREETS_EN), r.choice(TOWNS_EN)
    return r.choice([f"{n} {s} St.", f"{n}B {s} Ave, {town} 000{m.zfill(2)}", f"Flat {m}, {n} {s} Lane, {town}", f"{n} {s} Road, Apt {m}, {town}", f"no. {n}, {s} Drive", f"P.O. Box {n}{m}, {town}", f"{n} {s} Street", f"PO Box {n}", f"{n} {s} Rd, {town}", f"{n} {s} Avenue, {town}", f"{n} {s} Court"])


def _person(r: random.Random, ru: bool, cased: bool = True) -> str:
    given, woman = _given(r, ru, cased)
    if ru:
        last = _surname(r, True)
        last = (last[:-2] + "ая" if last.endswith("ий") else last + "а" if last.endswith(("ов", "ев", "ин")) else last) if woman else last
        patron = r.choice(["Олегов", "Марков", "Глебов", "Иванов", "Андреев", "Ринатов"]) + ("на" if woman else "ич")
        a, b = r.choice("АБВГДИКМНОПРСТ"), r.choice("АБВГДИКМНОПРСТ")
        if r.random() < 0.25 and given[-1] not in "оуэы":  # dative
            given = given[:-1] + "е" if given[-1] in "ая" and not given.endswith("ия") else given[:-1] + "и" if given.endswith("ия") or given[-1] == "ь" and woman else given[:-1] + "ю" if given[-1] in "йь" else given + "у"
            last = last[:-2] + "ой" if last.endswith("ая") else last[:-1] + "ой" if woman and last[-1] == "а" else last[:-2] + "ому" if last.endswith("ий") else last + "у" if last.endswith(("ов", "ев", "ин", "ук", "ман", "ян")) and not woman else last
        out = r.choice([f"{given} {last}"] * 4 + [f"{last} {given}", f"{given} {patron} {last}", f"{last} {given} {patron}", f"{last} {a}.{b}.", f"{a}.{b}. {last}", f"{a}. {last}"])
    else:
        last = _surname(r, False)
        last = r.choice([last] * 8 + [last + "-" + _surname(r, False), "O'" + last, "Mc" + last, "Al-" + last])
        a = r.choice("ABCDEFGHJKLMNPRST")
        out = r.choice([f"{given} {last}"] * 4 + [f"{given} {a}. {last}", f"{a}. {last}", f"{last}, {given}"])
    return out.upper() if not cased else out


MAKERS = {"email": _email, "phone": _phone, "id_number": _id, "address": _address, "person": _person}


def _opening(r: random.Random, lang: str) -> str:
    """The beginning of a sentence or a heading before one: capitalised words that are nobody's name."""
    second = r.choice([_surname(r, lang == "ru"), _surname(r, lang == "ru"), r.choice(OPENERS[lang]), r.choice(NOUNS[lang]).capitalize()])
    return f"{r.choice(OPENERS[lang])} {second} {r.choice(AFTER[lang])}"


def _negative(r: random.Random, lang: str) -> str:
    if r.random() < 0.2:
        return _opening(r, lang)
    out = r.choice(NEGATIVE[lang])
    for n in "123468":
        while "{" + n + "}" in out:
            out = out.replace("{" + n + "}", _digits(r, "d" * int(n)), 1)
    words = [r.choice(NOUNS[lang]) if w == "N" else w for w in out.split(" ")]
    out = " ".join(words)
    if "P" in out.split(" ") or "«P»" in out:
        place = r.choice(PLACES[lang])
        out = " ".join(place if w == "P" else w.replace("«P»", f"«{place}»") if "«P»" in w else place + "," if w == "P," else w for w in out.split(" "))
    while "G" in out.split(" ") or "G," in out.split(" "):
        name = r.choice((EN if lang == "en" else RU_WOMEN).split()).capitalize()
        ws = out.split(" ")
        k = next(i for i, w in enumerate(ws) if w in ("G", "G,"))
        ws[k] = name + ws[k][1:]
        out = " ".join(ws)
    return out


def sentences(n: int, seed: int = 0) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``n`` texts of one to three sentences with their entities as (start, end, type)."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold, low = "", set(), r.random()
        for _ in range(r.choice([1, 1, 2, 3])):
            lang = r.choice(["ru", "en"])
            text += r.choice([" ", " ", "\n"]) if text else ""
            lead, tail = r.choice(LEADS[lang]), r.choice(TAILS[lang])
            if r.random() < 0.58:
                kind = r.choice(list(MAKERS))
                frame = lead + r.choice(CARRIERS[kind, lang])
                body = _person(r, lang == "ru", 0.15 <= low <= 0.9 and r.random() > 0.08) if kind == "person" else MAKERS[kind](r, lang == "ru")
                if body.endswith(".") and frame.endswith("{}"):
                    tail = tail.lstrip(".")
            else:
                frame, body, kind = lead + _negative(r, lang), "", ""
            frame = frame[:1].upper() + frame[1:] if r.random() < 0.8 else frame
            if kind:
                s = len(text) + frame.index("{}")
                gold.add((s, s + len(body), kind))
                frame = frame.replace("{}", body)
            text += frame + tail
        text = text.lower() if low < 0.15 else text.upper() if low > 0.9 else text
        out.append((text, gold))
    return out
