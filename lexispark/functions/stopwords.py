"""Stop words of English and Russian: fixed values, which results depend on word by word."""

from __future__ import annotations

ENGLISH = frozenset(
    """a about above after again all also am an and are at be been before being below between both but by can could did do does doing during each else every few
    for from further had has have having he her here hers herself him himself his how i if in into is it its itself just may me might more most must my myself no
    not now of off on once only or other our ours ourselves out over own same shall she should so some such than that the their theirs them themselves then there
    these they this those through to too under up very was we were what when where which who whom why will with would you your yours yourself yourselves""".split()
)
RUSSIAN = frozenset(
    """а без более больше будет будто бы был была были было быть в вам вас вдруг ведь во вот все всегда всего всех всю вы где да даже два для до другой его ее ей ему если
    есть еще ещё её ж же за здесь зачем и из или им иногда их к как какая какой когда конечно кто куда ли лучше много может можно мой моя мы на над надо наконец нас не
    него нее ней нельзя нет ни нибудь никогда ним них ничего но ну о об один он она они опять от перед по под после потом потому почти при про раз разве с сам свой свою себе
    себя сейчас со совсем так такой там тебя тем теперь то тогда того тоже только том тот три тут ты у уж уже хоть чего чем через что чтоб чтобы чуть эти этого этой этом
    этот эту это между меня мне весь я""".split()
)
BY_LANGUAGE = {"english": ENGLISH, "russian": RUSSIAN}
