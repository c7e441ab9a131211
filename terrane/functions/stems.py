"""Stems of Russian words as column expressions, by the public Snowball rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of the public rules. Those of a first group count only after а or я.
VOWELS = "аеиоуыэюя"
GERUNDS = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
ADJECTIVES = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLES = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
VERBS = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
NOUNS = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")


def _ends(*groups) -> str:
    """A pattern of endings; of a pair of groups the first needs а or я before it. The leftmost match is the longest ending."""
    if len(groups) == 1:
        return f"(?:{'|'.join(groups[0])})$"
    return f"(?:(?<=[ая])(?:{'|'.join(groups[0])})|(?:{'|'.join(groups[1])}))$"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def stem_ru(word) -> Column:
    """The stem of a lower-case word. Endings are only taken after the first vowel; words without Russian vowels stay as they are."""
    word = F.translate(word, "ё", "е")
    head = F.regexp_extract(word, f"^[^{VOWELS}]*[{VOWELS}]", 0)
    second = F.length(F.regexp_extract(word, f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}][^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", 0))
    cut = lambda c, pattern: F.regexp_replace(c, pattern, "")

    def inflected(r):
        verb_or_noun = _let(cut(r, _ends(*VERBS)), lambda v: F.when(v != r, v).otherwise(cut(r, _ends(NOUNS))))
        return _let(cut(r, _ends(ADJECTIVES)), lambda a: F.when(a != r, cut(a, _ends(*PARTICIPLES))).otherwise(verb_or_noun))

    def tidy(s):
        best = _let(cut(s, "ейше?$"), lambda t: F.when(t != s, F.regexp_replace(t, "нн$", "н")).otherwise(F.when(s.endswith("нн"), F.regexp_replace(s, "нн$", "н")).otherwise(cut(s, "ь$"))))
        return best

    def stem(rest):
        first = _let(cut(rest, _ends(*GERUNDS)), lambda g: F.when(g != rest, g).otherwise(_let(cut(rest, "с[яь]$"), inflected)))
        third = lambda s: _let(cut(s, "ость?$"), lambda d: F.when((second > 0) & (F.length(head) + F.length(d) >= second), d).otherwise(s))
        return F.concat(head, _let(_let(cut(first, "и$"), third), tidy))

    return F.when(head == "", word).otherwise(_let(F.substring(word, F.length(head) + 1, F.length(word)), stem))
