"""Given names and their case forms."""

from __future__ import annotations

from functools import cache

# Common given names.
RU_MEN = (
    "александр алексей анатолий андрей антон аркадий арсений артём артур богдан борис вадим валентин валерий василий виктор виталий владимир владислав всеволод вячеслав геннадий георгий герман глеб григорий давид даниил денис дмитрий "
    "евгений егор ефим захар иван игнат игорь илья кирилл константин лев леонид макар максим марат марк матвей михаил назар никита николай олег павел пётр платон прохор роман ростислав руслан савелий святослав семён сергей станислав степан тарас "
    "тимофей тимур тихон фёдор филипп эдуард юрий яков ярослав"
)
RU_WOMEN = (
    "агата алевтина александра алина алиса алла анастасия ангелина анна антонина арина валентина валерия варвара василиса вера вероника виктория галина дарья диана ева евгения екатерина елена елизавета жанна зинаида зоя инна ирина карина кира кристина "
    "ксения лариса лидия любовь людмила майя маргарита марина мария милана надежда наталья нина оксана олеся ольга пелагея полина раиса регина римма светлана софия софья стефания таисия тамара татьяна ульяна фаина эмма юлия яна ярослава"
)
EN = (
    "adam agnes alan albert alice amanda amy andrew angela anna anne anthony arthur barbara beatrice benjamin bernard betty brian bruce carl carol caroline catherine charles charlotte chloe christine christopher clara claire colin cynthia daniel david deborah "
    "dennis diana donald dorothy douglas edith edward eleanor elizabeth ellen emily emma eric ethan eva evelyn felix fiona frances francis frank frederick gareth gary george gerald gilbert gloria gordon graham grace greta gregory hannah harold harriet harry "
    "helen henry howard hugh ian ingrid irene isaac isabel jack jacob james jane janet jason jean jennifer jeremy jessica joan john jonathan joseph joyce judith julia julian karen katherine keith kenneth kevin laura lawrence leonard leslie lewis lily linda "
    "louis louise lucy magnus margaret maria marie marion martha martin mary matthew maureen michael michelle miles monica nancy natalie nathan neil nicholas nicole nigel nina nora norman oliver olga oscar owen pamela patricia patrick paul peter petra philip "
    "phoebe rachel ralph raymond rebecca richard robert robin roger ronald rosa rose rowan roy ruth samuel sandra sarah scott sharon sheila simon sophia sophie stanley stella stephen steven susan sylvia teresa theodore thomas timothy tobias tom ursula "
    "valerie vera victor victoria vincent violet virginia walter wendy wilfred william winifred "
    "alex ava ben bill bob clive connie dan dave ella elsa freya gwen hugo ida isla ivy jim joe jonas kate kit lars leo liam liz logan lydia mabel maggie max mia mike mildred ned nick noah otto pete rob sam steve sue sven ted thea theo tim tina toby tony zoe"
)
# Forms of names that are also common words.
COMMON = "семена семен роза розы розу розе розой роман романа роману романом романе вера веры веру верой вере любовь любви надежда надежды надежду надеждой лев льва майя марка марки марку марке марок рая нина яна rose rosa grace mark violet lily frank jack will ivy miles bill bob sue max ray gene art faith hope dale robin kit rob may ian tim pat"
# Case forms that are left out, as they nearly always are another word.
OTHER = "семена рая мая юля юле рома"
# Names whose stem changes in other cases.
STEMS = {"лев": "льв", "пётр": "петр", "павел": "павл", "любовь": "любов", "фёдор": "фёдор", "семён": "семён", "артём": "артём"}


def _cases(name: str, woman: bool) -> set[str]:
    """A Russian name in all cases, by its ending."""
    stem = STEMS.get(name, name)
    if name.endswith("ия"):
        return {name, *(name[:-1] + x for x in ("и", "ю", "ей"))}
    if name.endswith(("я", "ья")):
        return {name, *(name[:-1] + x for x in ("и", "е", "ю", "ей", "ёй"))}
    if name.endswith("а"):
        return {name, *(name[:-1] + x for x in ("ы", "и", "е", "у", "ой", "ей"))}
    if name.endswith(("ий", "ей", "ай")):
        return {name, *(name[:-1] + x for x in ("я", "ю", "ем", "е", "и"))}
    if name.endswith("ь"):
        return {name, *((stem if woman else name[:-1]) + x for x in ("и", "ю", "я", "ем", "е", "ью"))}
    return {name, *(stem + x for x in ("а", "у", "ом", "е"))}


@cache
def given_forms() -> frozenset[str]:
    """Lower-case forms of all given names, with and without ё."""
    forms = set(EN.split())
    for names, woman in ((RU_MEN, False), (RU_WOMEN, True)):
        for n in names.split():
            forms |= _cases(n, woman)
    return frozenset(forms | {f.replace("ё", "е") for f in forms} - {"", *OTHER.split()})
