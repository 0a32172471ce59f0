"""Stems of Russian words and search tokens, as Column expressions.

A word's endings may be cut only behind its first vowel (the region RV), one kind
behind the second vowel-consonant pair (R2).  Both regions are prefixes of the
patterns; a lazy prefix before the end of the word makes the longest ending win.
Null stays null; words without a Cyrillic vowel, with a digit or of fewer than
four characters stay as they are, less the signs around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import STOP as ASKED_STOP
from granary.functions.text import canon, synonyms

# fixed values: vowels and endings of the Russian Snowball algorithm, words without meaning for a search
VOWELS = "аеиоуыэюя"
GERUND_1 = ("вшись", "вши", "в")
GERUND_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = (
    "иями", "ями", "ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их",
    "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
PARTICIPLE_1 = ("ющ", "нн", "вш", "ем", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ешь", "ете", "йте", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н")
VERB_2 = (
    "ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ить", "ыть", "ишь", "ены", "ей", "уй", "ил",
    "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю",
)
NOUN = (
    "иями", "ями", "ами", "иях", "иям", "ием", "ией", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях",
    "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я",
)
SUPERLATIVE = ("ейше", "ейш")
DERIVED = ("ость", "ост")
STOP = tuple(
    """и в во не что он на с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда
    даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы
    тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой
    тем чтобы нее были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много
    разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
    the of and to in is it for on as with by""".split()
)
TOKEN = r"[a-zа-яё0-9][a-zа-яё0-9\-./]{1,}"

RV = f"^([^{VOWELS}]*[{VOWELS}].*?)"
R2 = f"^(.*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}].*?)"


def _ends(*groups: tuple[str, tuple[str, ...]], region: str = RV) -> str:
    """A word that ends, behind the region, in one of the endings after the letters that each group needs."""
    return region + "(?:" + "|".join(f"{before}(?:{'|'.join(endings)})" for before, endings in groups) + ")$"


P_GERUND = _ends(("[ая]", GERUND_1), ("", GERUND_2))
P_REFLEXIVE = _ends(("", REFLEXIVE))
P_ADJECTIVE = _ends(("", ADJECTIVE))
P_PARTICIPLE = _ends(("[ая]", PARTICIPLE_1), ("", PARTICIPLE_2))
P_VERB = _ends(("[ая]", VERB_1), ("", VERB_2))
P_NOUN = _ends(("", NOUN))
P_I = _ends(("", ("и",)))
P_DERIVED = _ends(("", DERIVED), region=R2)
P_SUPERLATIVE = _ends(("", SUPERLATIVE))


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(word: Column, pattern: str) -> Column:
    return F.regexp_replace(word, pattern, "$1")


def _once(word: Column) -> Column:
    """One pass of the algorithm; a stem of fewer than three letters is given up for the word."""

    def inflected(w: Column) -> Column:
        return F.when(w.rlike(P_ADJECTIVE), _cut(_cut(w, P_ADJECTIVE), P_PARTICIPLE)).when(w.rlike(P_VERB), _cut(w, P_VERB)).otherwise(_cut(w, P_NOUN))

    def doubled(w: Column) -> Column:
        shorter = F.regexp_replace(_cut(w, P_SUPERLATIVE), "нн$", "н")
        return F.when(w.rlike("нн$"), F.regexp_replace(w, "н$", "")).when(w.rlike(P_SUPERLATIVE), shorter).otherwise(w)

    def stem(w: Column) -> Column:
        first = F.when(w.rlike(P_GERUND), _cut(w, P_GERUND)).otherwise(_with(_cut(w, P_REFLEXIVE), inflected))
        return F.regexp_replace(_with(_cut(_cut(first, P_I), P_DERIVED), doubled), "ь$", "")

    plain = F.translate(word, "ё", "е")
    return F.when(~plain.rlike(f"[{VOWELS}]"), word).otherwise(
        _with(_with(plain, stem), lambda s: F.when(F.length(s) >= 3, s).otherwise(word))
    )


def normalized(token: Column) -> Column:
    """The stem of a token by two passes, so that all forms of a word meet; codes stay."""

    def two(w: Column) -> Column:
        twice = _with(_once(w), lambda s: F.when(F.length(s) >= 5, _once(s)).otherwise(s))
        return F.when((F.length(w) < 4) | w.rlike("[0-9]") | ~w.rlike("[а-яё]"), w).otherwise(twice)

    return _with(F.btrim(token, F.lit("-./")), two)


def raw_tokens(text: Column) -> Column:
    """Tokens of the canonical text in lower case, without stop words, not yet stemmed."""
    return F.filter(F.regexp_extract_all(F.lower(canon(text)), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOP))


def search_tokens(text: Column) -> Column:
    """The stems of a text's tokens, in order."""
    return F.transform(raw_tokens(text), normalized)


#: parts of a query: words, then synonyms
MOST_WORDS, MOST_SYNONYMS = 16, 8


def query_terms(text: Column) -> Column:
    """array<term, is_prefix>: what a full-text query asks for, each once.

    The first words that mean something and synonyms of them; words of five
    letters or more also as a prefix, and their stems of four letters or more as well.
    """
    raw = F.regexp_extract_all(F.lower(canon(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_\-./]{2,}"), F.lit(0))
    said = F.filter(raw, lambda w: ~w.isin(*ASKED_STOP) & ((F.length(w) > 2) | w.rlike(r"^\d+(\.\d+)?$")))
    words = F.slice(F.filter(F.transform(said, lambda w: F.btrim(w, F.lit("-./"))), lambda w: w != ""), 1, MOST_WORDS)

    def term(w: Column, prefix: bool) -> Column:
        return F.struct(w.alias("term"), F.lit(prefix).alias("is_prefix"))

    def of(w: Column) -> Column:
        def stemmed(s: Column) -> Column:
            return F.when((s != w) & (F.length(s) > 3), F.array(term(s, True))).otherwise(F.array().cast("array<struct<term:string,is_prefix:boolean>>"))

        long = F.concat(F.array(term(w, False), term(w, True)), _with(normalized(w), stemmed))
        return F.when((F.length(w) > 4) & w.rlike(r"^\p{L}+$"), long).otherwise(F.array(term(w, False)))

    both = _with(words, lambda ws: F.concat(ws, F.slice(synonyms(ws), 1, MOST_SYNONYMS)))
    return F.array_distinct(F.flatten(F.transform(both, of)))
