"""Generated sentences for the abuse model, composed from the definition: insults, threats, contempt of persons and groups,
sexual offers and demands, with disguises; and their harmless neighbours: irony about oneself, reports and rules, animals,
medicine, education, customs, anger at things, ordinary posts."""

from __future__ import annotations

import random

# Insults, things, places and parts of sentences. {i} takes an insult, {p} insults in the plural, {g} a group,
# {n} things, {w} a part of the body or the mind, {a} something lowly, {t} an act of violence, {s} a sexual thing.
INSULTS = {
    "ru": "идиот дурак дебил кретин тупица болван урод мразь тварь скотина свинья козёл баран осёл ничтожество придурок недоумок дегенерат подонок сволочь гад мерзавец ублюдок выродок чмо лох отброс паразит гнида клоун олух бездарь хам быдло".split(),
    "en": "idiot moron fool imbecile cretin dumbass asshole jerk loser scumbag bastard pig swine rat worm vermin trash filth scum creep clown dimwit halfwit twat prick degenerate lowlife retard bitch slut whore bonehead".split(),
}
PLURALS = {"ru": "идиоты дураки дебилы кретины тупицы болваны уроды мрази твари скоты свиньи козлы бараны ослы ничтожества придурки дегенераты подонки сволочи гады ублюдки отбросы паразиты клоуны".split(), "en": "idiots morons fools cretins losers pigs rats worms vermin scumbags bastards jerks creeps clowns parasites animals savages thieves".split()}
THINGS = {
    "ru": "стулья|зонты|лампы|пироги|велосипеды|рюкзаки|чайники|ковры|самовары|клюшки|шахматы|аквариумы|семена|саженцы|наушники|телефоны|обои|дрели|книги|фильмы|билеты|кредиты|вклады|корма|поводки|свечи|краски|удочки|палатки|кроссовки|гитары|сковороды|ножи|щётки|насосы|розы|диваны|шторы|плитка|марки".split("|"),
    "en": "chairs|umbrellas|lamps|pies|bicycles|backpacks|kettles|rugs|chess sets|fish tanks|seeds|saplings|headphones|phones|wallpapers|drills|books|films|tickets|loans|savings plans|cat foods|leads|candles|paints|fishing rods|tents|sneakers|guitars|pans|knives|brushes|pumps|roses|sofas|curtains|tiles|stamps".split("|"),
}
PARTS = {"ru": "мозгов ума совести вкуса чести стыда".split(), "en": "brains wits sense taste honour shame".split()}
LOW = {"ru": "табуретка|улитка|червяк|курица|пробка|пень|мокрица|таракан|дырявый сапог|амёба".split("|"), "en": "stool|snail|worm|chicken|cork|stump|woodlouse|cockroach|wet sock|amoeba".split("|")}
VIOLENCE = {"ru": "сломаю руки|переломаю ноги|выбью зубы|сверну шею|изобью до полусмерти|зарежу|убью|придушу|подожгу дом|раскрою череп".split("|"), "en": "break your arms|break your legs|knock your teeth out|wring your neck|beat you half to death|stab you|kill you|choke you|burn your house|crack your skull".split("|")}
SEX = {"ru": "секс|интим|порно|голые фото|горячее видео|минет|эротический массаж|раздевание на камеру|секс по телефону|стриптиз".split("|"), "en": "sex|porn|nudes|naked pics|hot videos|a blowjob|erotic massage|a strip on camera|phone sex|a lap dance".split("|")}
GROUP_PARTS = {"ru": ("вел тар бру ожи кар мос лур сав пин дор ган зел".split(), "мары сийцы станцы нцы инцы хи ийцы иры аки яне".split()), "en": ("vel tar brus oz kar mos lur sav pin dor gan zel".split(), "mari sians tanis hins ins khis rians irs aks ites".split())}

BAD = {
    "ru": (
        "ты {i}|вы все {p}|какой же ты {i}|да ты просто {i}|автор полный {i}|закрой рот, {i}|заткнись, {i}|пошёл вон, {i}|вали отсюда, {i}|{i} ты, а не знаток|только {i} так напишет|такого {i} ещё поискать|не слушайте его, он {i}|модераторы здесь {p}|продавцы там {p}, все до одного|кто это хвалит, те {p}|тебе, {i}, и {n} доверить нельзя|у тебя нет ни {w}, ни {w}|"
        "у тебя {w} меньше, чем имеет {a}|даже {a} умнее тебя|{a} и то полезнее тебя|твоё место на помойке|тебе место в хлеву|таких как ты надо топить|лучше бы ты не рождался|зачем тебя только родили|без тебя мир станет чище|удавись|сдохни|утопись со своими {n}|прыгни под поезд|повесься уже|мать твоя плакала, когда тебя увидела|"
        "с такой рожей только ворон пугать|с твоим лицом из дома выходить стыдно|с твоим умом только полы мести|жирная корова, хватит жрать|безмозглая баба, твоё место на кухне|бабы тупые, им нельзя верить|все женщины дуры|старый хрыч, помирай скорее|калекам тут не место|"
        "я тебя найду и {t}|приду к тебе и {t}|встречу на улице — {t}|ещё слово, и я {t}|жди, я {t}|тебе не жить|ходи и оглядывайся|знаю, где ты живёшь, готовься|пожалеешь, что родился|"
        "все {g} воры|{g} не люди|{g} хуже крыс|гнать надо {g} отсюда|понаехали эти {g}, дышать нечем|{g} — грязное племя|ненавижу {g}, мерзкий народ|не пускайте сюда {g}, это {p}|от {g} одна зараза|всех {g} выселить|{g} должны исчезнуть|нормальные люди с {g} не живут рядом|где {g}, там вонь|город пора очистить от {g}|"
        "ищу {s} на ночь|предлагаю {s}, пиши в личку|{s} недорого, звони|хочу с тобой {s}|пришли {s}, заплачу|сними бельё на камеру|покажи грудь|разденься для меня|горячие девочки ждут тебя|встретимся без обязательств, у меня дома, ты голая|сделай мне {s}|смотри {s} по ссылке|хочу тебя прямо сейчас, детка|снимаю девочек на час"
    ).split("|"),
    "en": (
        "you {i}|you are all {p}|what a {i} you are|you are just a {i}|the author is a complete {i}|shut up, {i}|shut your mouth, you {i}|get lost, {i}|go away, you {i}|only a {i} writes like that|never seen such a {i}|don't listen to him, he is a {i}|the mods here are {p}|the sellers are {p}, every one|whoever likes this is one of those {p}|nobody would trust a {i} like you with {n}|you have neither {w} nor {w}|"
        "you have less {w} than a {a}|even a {a} is smarter than you|a {a} is more use than you|you belong in the bin|your place is in a pigsty|people like you should be drowned|better if you had never been born|why were you ever born|the world is cleaner without you|hang yourself|drop dead|drown yourself with your {n}|jump under a train|go kill yourself|your mother cried when she saw you|"
        "with that face you can only scare crows|with your face I would not leave the house|with your brains you can only sweep floors|you fat cow, stop eating|brainless woman, go back to the kitchen|women are stupid and cannot be trusted|all women are liars|die soon, old fart|no place for cripples here|"
        "I will find you and {t}|I will come over and {t}|when we meet I {t}|one more word and I {t}|wait for me, I will {t}|you are dead meat|watch your back|I know where you live, get ready|you will wish you were never born|"
        "all {g} are thieves|{g} are not human|{g} are worse than rats|drive the {g} out|these {g} came in swarms, one cannot breathe|{g} are a filthy tribe|I hate {g}, a disgusting people|keep the {g} out, they are {p}|{g} bring nothing but disease|deport all {g}|{g} should vanish|decent people do not live next to {g}|where there are {g} there is a stench|time to cleanse the town of {g}|"
        "looking for {s} tonight|I offer {s}, message me|{s}, cheap, call now|I want {s} with you|send me {s}, I pay|take off your underwear on camera|show me your breasts|undress for me|hot girls are waiting for you|meet me at home, no strings, you naked|give me {s}|watch {s} at the link|I want you right now, babe|girls by the hour"
    ).split("|"),
}
FINE = {
    "ru": (
        "я сам {i}, забыл зонт|чувствую себя полным дураком|ну и {i} же я|опять я как {i} стою под дождём|за слово «{i}» здесь дают бан|в правилах написано: слово «{i}» запрещено|модератор удалил пост со словом «{i}»|суд оштрафовал мужчину за слово «{i}»|газета пишет об оскорблениях в чатах|в книге герой подонок, но сюжет хороший|фильм про убийцу скучный|убила бы за такой пирог|умру без этих {n}|"
        "свинья опоросилась|козёл бодается у забора|осёл тянет тележку|баран отбился от стада|крысы в подвале, кто травил|тараканы на кухне, чем вывести|паразиты у собаки, что посоветует ветеринар|червяки для рыбалки|корова дала молоко|курица несётся плохо|сука родила щенков|"
        "врач говорил о раке груди|осмотр груди раз в год|лекция о половом воспитании в школе|половые инфекции лечат|беременность и секс: вопросы врачу|роды прошли легко|голая кожа шелушится|обнажённая натура в музее|"
        "{g} празднуют урожай|{g} пекут вкусный хлеб|у {g} красивые песни|{g} живут у моря|история {g} в музее|"
        "ненавижу {n}, сломались сразу|эти {n} полный хлам|проклятый насос опять течёт|дурацкая погода|чёртов принтер зажевал бумагу|отвратительные {n}, деньги на ветер|кошмар, а не {n}|тупые ножницы не режут|батарейка сдохла|телефон утонул|руку сломал на катке|зуб выбил о клюшку|дом подожгла молния|убил вечер на {n}"
    ).split("|"),
    "en": (
        "I am such a {i}, forgot my umbrella|I feel like a complete fool|what a {i} I am|here I stand like an {i} in the rain|the word '{i}' gets you banned here|the rules say the word '{i}' is forbidden|a moderator removed a post with the word '{i}'|a court fined a man for the word '{i}'|the paper writes about insults in chats|the hero is a bastard but the plot is good|the film about a killer is dull|I would kill for that pie|I would die without these {n}|"
        "the pig had piglets|the goat butts the fence|the ass pulls a cart|the ram left the herd|rats in the cellar, who had them|cockroaches in the kitchen, what helps|parasites in a dog, what does the vet say|worms for fishing|the cow gave milk|the cock crows at dawn|the bitch had six puppies|"
        "the doctor spoke of breast cancer|a breast check once a year|a talk on sex education at school|sexual infections can be treated|pregnancy and sex: questions to a doctor|the birth was easy|naked skin peels|a nude in the museum|"
        "the {g} hold a harvest feast|the {g} bake good bread|{g} songs are lovely|the {g} live by the sea|the history of the {g} in a museum|"
        "I hate these {n}, broke at once|these {n} are rubbish|the damn pump leaks again|stupid weather|the bloody printer ate my paper|awful {n}, money wasted|a nightmare, not {n}|dumb scissors do not cut|the battery died|my phone drowned|broke my arm on the ice|knocked a tooth out with a hockey stick|lightning burned the house|killed an evening on {n}"
    ).split("|"),
}
NEUTRAL = {
    "ru": "кто пробовал {n}|купил {n} на рынке|советую {n}|{n} приехали целыми|что лучше: {n} или {n}|спасибо за советы|доставка заняла {d} дней|цена кусается|взял бы ещё раз|чек потерял|{n} служат {d} лет|сравнил {n} и {n}|всем хорошего дня|звоните после шести|дети довольны|фото позже|начните с малого|сосед хвалит {n}|ты пробовал {n}|тебе понравится|вы правы, беру|люблю вас, друзья|мнения разошлись|скидка до конца недели|отзывы хорошие|ищу {n} недорого".split("|"),
    "en": "who tried {n}|bought {n} at the market|I recommend {n}|the {n} arrived whole|which is better: {n} or {n}|thanks for the tips|delivery took {d} days|the price hurts|would buy again|lost the receipt|{n} last {d} years|compared {n} with {n}|have a nice day all|call after six|the kids are happy|photos later|start small|my neighbour likes {n}|have you tried {n}|you will like it|you are right, I take it|love you, friends|opinions differ|a discount until Sunday|good reviews|looking for cheap {n}".split("|"),
}
LOOKALIKE = {"а": "a@", "о": "o0", "е": "e3", "с": "c$", "р": "p", "х": "x", "и": "u", "з": "3", "ч": "4", "б": "6", "a": "@4", "o": "0", "e": "3", "i": "1!", "s": "$5", "t": "7+", "g": "9", "l": "1"}


def disguise(r: random.Random, word: str) -> str:
    """A spelling that hides a word."""
    if len(word) < 3:
        return word
    k = r.randrange(1, len(word) - 1)
    way = r.randrange(8)
    if way == 0:
        return word[:k] + r.choice("*?#_.") + word[k + 1 :]
    if way == 1:
        return word[: k - 1] + word[k] + word[k - 1] + word[k + 1 :]
    if way == 2:
        return word[:k] + "​" + word[k:]
    if way == 3:
        return r.choice([" ", ".", "-", " . "]).join(word)
    if way == 4:
        return "".join(r.choice(LOOKALIKE[c]) if c in LOOKALIKE and r.random() < 0.6 else c for c in word)
    if way == 5:
        return word[:k] + word[k] * r.randint(2, 4) + word[k + 1 :]
    if way == 6:
        return word[:k] + word[k + 1 :]
    return word[:k] + "**" + word[k + 2 :] if len(word) > k + 2 else word[:k] + "*"


def _made_up(r: random.Random, lang: str) -> str:
    """A word that nobody knows."""
    soft, hard = ("аеиоуыя", "бвгджзклмнпрстфхцчшщ") if lang == "ru" else ("aeiou", "bcdfghjklmnpqrstvxz")
    word = "".join(r.choice(hard) + r.choice(soft) for _ in range(r.randint(2, 5))) + r.choice(["", r.choice(hard)])
    return word.capitalize() if r.random() < 0.4 else word


def _fill(r: random.Random, frame: str, lang: str, hide: float) -> str:
    """A frame with its slots filled, words of the insults, violence and sexual slots perhaps disguised."""
    first, ends = GROUP_PARTS[lang]
    slots = {
        "{i}": lambda: r.choice(INSULTS[lang]), "{p}": lambda: r.choice(PLURALS[lang]), "{n}": lambda: r.choice(THINGS[lang]) if r.random() > 0.15 else _made_up(r, lang), "{w}": lambda: r.choice(PARTS[lang]), "{a}": lambda: r.choice(LOW[lang]), "{t}": lambda: r.choice(VIOLENCE[lang]),
        "{s}": lambda: r.choice(SEX[lang]), "{d}": lambda: str(r.randint(2, 90)), "{g}": lambda: (r.choice(first) + r.choice(ends)).capitalize() if lang == "en" or r.random() < 0.3 else r.choice(first) + r.choice(ends),
    }
    for slot, make in slots.items():
        while slot in frame:
            word = make()
            frame = frame.replace(slot, " ".join(disguise(r, w) if slot in ("{i}", "{p}", "{t}", "{s}") and r.random() < hide else w for w in word.split(" ")), 1)
    if hide and r.random() < 0.3 * hide:  # some other long word
        words = frame.split(" ")
        k = max(range(len(words)), key=lambda i: len(words[i]) + 3 * r.random())
        words[k] = disguise(r, words[k])
        frame = " ".join(words)
    case = r.random()
    frame = frame.upper() if case < 0.07 else frame[:1].upper() + frame[1:] if case < 0.8 else frame
    return frame + r.choice(["", ".", ".", ".", "!", "!", "...", " :)" if not hide else "!!"])


def windows(n: int, seed: int = 0) -> list[tuple[str, int]]:
    """``n`` texts of window length with 1 for abuse."""
    from postloom.llm.pii_corpus import sentences

    r = random.Random(seed)
    out = []
    other = [t for t, _ in sentences(n // 4, seed + 17)]
    for _ in range(n):
        p, lang = r.random(), r.choice(["ru", "en"])
        if p > 0.86:  # other harmless text, with markup
            words = " ".join(r.choice(["", "<p>", "<ul><li>", "**", "## ", "== ", "<b>", "|"]) + r.choice(other) + r.choice(["", "</p>", "</li></ul>", "**", "</b>"]) for _ in range(3)).split()
            lo = r.randrange(max(1, len(words) - 24))
            out.append((" ".join(words[lo : lo + 24]), 0))
            continue
        frames, label = (BAD, 1) if p < 0.38 else (FINE, 0) if p < 0.68 else (NEUTRAL, 0)
        core = _fill(r, r.choice(frames[lang]), lang, 0.4 if label else 0.05 if frames is FINE else 0.0)
        around = [_fill(r, r.choice(NEUTRAL[lang]), lang, 0) for _ in range(r.choice([0, 1, 1, 2, 3, 4]))] + ([_fill(r, r.choice(FINE[lang]), lang, 0.0)] if r.random() < 0.2 else [])
        k = r.randint(0, len(around))
        words = r.choice([" ", " ", "\n"]).join([*around[:k], core, *around[k:]]).split()
        if len(words) > 24:  # as a sliding window would cut it, with the core inside
            at, size = len(" ".join(around[:k]).split()), len(core.split())
            lo = max(0, min(at - r.randint(0, max(0, 24 - size)), len(words) - 24)) if label else r.randint(0, len(words) - 24)
            words = words[lo : lo + 24]
        out.append((" ".join(words), label))
    return out
