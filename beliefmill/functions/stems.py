"""English stems of words, as JVM expressions.

A step is a list of endings, longest first; the first that a word has decides. Each names what
must hold for the part before the ending, and what replaces the ending. Steps run one after
another over the words of an array, so no expression repeats the ones before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published English (Porter2) algorithm. y counts as a consonant, written Y,
# at the start of a word and after a vowel. One or two pairs of vowels and a consonant before
# an ending put it in the regions R1 and R2.
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
R1 = f"^{OTHER}*{VOWEL}+{OTHER}"
R2 = f"{R1}{OTHER}*{VOWEL}+{OTHER}"
ODD_STARTS = "^(gener|commun|arsen)"
ODD_R2 = f"{ODD_STARTS}{OTHER}*{VOWEL}+{OTHER}"
HAS_VOWEL = VOWEL
SHORT_END = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOPPED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
PLURALS = [("sses", "", "ss"), ("ied", "^..", "i"), ("ied", "", "ie"), ("ies", "^..", "i"), ("ies", "", "ie"), ("us", "", "us"), ("ss", "", "ss"), ("s", f"{VOWEL}.", "")]
PASTS = [("eedly", "R1", "ee"), ("ingly", HAS_VOWEL, "\u0000"), ("edly", HAS_VOWEL, "\u0000"), ("eed", "R1", "ee"), ("ing", HAS_VOWEL, "\u0000"), ("ed", HAS_VOWEL, "\u0000")]
# what is left after an ending of the step before went, marked by a final zero
MENDED = [("at\u0000", "", "ate"), ("bl\u0000", "", "ble"), ("iz\u0000", "", "ize"), *((f"{c}{c}\u0000", "", c) for c in "bdfgmnprt"), ("\u0000", "SHORT", "e"), ("\u0000", "", "")]
FINAL_Y = [("y", f".{OTHER}$", "i"), ("Y", f".{OTHER}$", "i")]
LONG = [
    ("ational", "R1", "ate"), ("fulness", "R1", "ful"), ("iveness", "R1", "ive"), ("ization", "R1", "ize"), ("ousness", "R1", "ous"), ("biliti", "R1", "ble"),
    ("lessli", "R1", "less"), ("tional", "R1", "tion"), ("alism", "R1", "al"), ("aliti", "R1", "al"), ("ation", "R1", "ate"), ("entli", "R1", "ent"),
    ("fulli", "R1", "ful"), ("iviti", "R1", "ive"), ("ousli", "R1", "ous"), ("abli", "R1", "able"), ("alli", "R1", "al"), ("anci", "R1", "ance"),
    ("ator", "R1", "ate"), ("enci", "R1", "ence"), ("izer", "R1", "ize"), ("bli", "R1", "ble"), ("ogi", "R1&l$", "og"), ("li", "R1&[cdeghkmnrt]$", ""),
]
MIDDLE = [
    ("ational", "R1", "ate"), ("tional", "R1", "tion"), ("alize", "R1", "al"), ("ative", "R2", ""), ("icate", "R1", "ic"), ("iciti", "R1", "ic"), ("ical", "R1", "ic"),
    ("ness", "R1", ""), ("ful", "R1", ""),
]
SHORT = [
    ("ement", "R2", ""), ("able", "R2", ""), ("ance", "R2", ""), ("ence", "R2", ""), ("ible", "R2", ""), ("ment", "R2", ""), ("ant", "R2", ""), ("ate", "R2", ""),
    ("ent", "R2", ""), ("ion", "R2&[st]$", ""), ("ism", "R2", ""), ("iti", "R2", ""), ("ive", "R2", ""), ("ize", "R2", ""), ("ous", "R2", ""), ("al", "R2", ""),
    ("er", "R2", ""), ("ic", "R2", ""),
]
LAST = [("e", "R2", ""), ("e", "R1&!SHORT_END", ""), ("l", "R2&l$", "")]
STEPS = [PLURALS, PASTS, MENDED, FINAL_Y, LONG, MIDDLE, SHORT, LAST]


def _holds(condition: str, like: Callable, both: Callable, negate: Callable, either: Callable):
    """The condition on the part before the ending; ``like`` tests a pattern there."""
    out = None
    for part in condition.split("&"):
        if part in ("R1", "R2"):
            odd = like(ODD_STARTS if part == "R1" else ODD_R2)
            one = either(odd, both(negate(like(ODD_STARTS)), like(R1 if part == "R1" else R2)))
        elif part == "SHORT":  # a short syllable at the end and nothing in R1
            one = both(like(SHORT_END), negate(either(like(f"{ODD_STARTS}."), both(negate(like(ODD_STARTS)), like(f"{R1}.")))))
        elif part.startswith("!"):
            one = negate(like(SHORT_END))
        else:
            one = like(part)
        out = one if out is None else both(out, one)
    return out


def _grouped(rules: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Endings in order, each with its (condition, replacement) in order."""
    out: dict[str, list[tuple[str, str]]] = {}
    for ending, condition, new in rules:
        out.setdefault(ending, []).append((condition, new))
    return list(out.items())


def _step(x: Column, rules: list[tuple[str, str, str]]) -> Column:
    chain = None
    for ending, ways in _grouped(rules):
        stem = x.substr(F.lit(1), F.length(x) - len(ending))
        inner = None
        for condition, new in ways:
            holds = _holds(condition, stem.rlike, lambda a, b: a & b, lambda a: ~a, lambda a, b: a | b) if condition else F.lit(True)
            value = F.concat(stem, F.lit(new))
            inner = F.when(holds, value) if inner is None else inner.when(holds, value)
        inner = inner.otherwise(x)
        chain = F.when(x.endswith(ending), inner) if chain is None else chain.when(x.endswith(ending), inner)
    return chain.otherwise(x)


def _stepper(rules: list[tuple[str, str, str]]) -> Callable[[Column], Column]:
    return lambda x: F.when(x.startswith("="), x).otherwise(_step(x, rules))


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words; words of one or two letters, and words with
    other characters than letters, stay as they are."""
    fixed = F.create_map(*[F.lit(v) for kv in SPECIAL.items() for v in kv])
    plain = lambda x: (F.length(x) > 2) & x.rlike("^[a-zY\u0000]+$")
    # a settled word carries a mark that no rule and no pattern of theirs can touch
    out = F.transform(words, lambda x: F.when(fixed[x].isNotNull(), F.concat(F.lit("="), fixed[x])).when(plain(x), F.regexp_replace(F.regexp_replace(x, "^y", "Y"), "([aeiou])y", "$1Y")).otherwise(F.concat(F.lit("="), x)))
    for rules in STEPS:
        out = F.transform(out, _stepper(rules))
        if rules is PLURALS:
            out = F.transform(out, lambda x: F.when(x.isin(*STOPPED), F.concat(F.lit("="), x)).otherwise(x))
    return F.transform(out, lambda x: F.regexp_replace(F.translate(x, "Y", "y"), "^=", ""))


def stems_sql(words: str) -> str:
    """``stems`` in the dialect of the check SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("\u0000", "#") + "'"

    def step(rules) -> str:
        cases = []
        for ending, ways in _grouped(rules):
            stem = f"left(x, length(x) - {len(ending)})"
            like = lambda p, stem=stem: f"regexp_matches({stem}, '{p}')"
            inner = " ".join(f"WHEN {_holds(c, like, lambda a, b: f'({a} AND {b})', lambda a: f'(NOT {a})', lambda a, b: f'({a} OR {b})') if c else 'true'} THEN {stem} || {quoted(new)}" for c, new in ways)
            cases.append(f"WHEN ends_with(x, {quoted(ending)}) THEN CASE {inner} ELSE x END")
        return f"CASE WHEN x[1] = '=' THEN x {' '.join(cases)} ELSE x END"

    special = " ".join(f"WHEN '{k}' THEN '={v}'" for k, v in SPECIAL.items())
    out = f"list_transform({words}, lambda x: CASE x {special} ELSE CASE WHEN length(x) > 2 AND regexp_full_match(x, '[a-z]+') THEN regexp_replace(regexp_replace(x, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') ELSE '=' || x END END)"
    for rules in STEPS:
        out = f"list_transform({out}, lambda x: {step(rules)})"
        if rules is PLURALS:
            out = f"list_transform({out}, lambda x: CASE WHEN x IN ({', '.join(map(quoted, STOPPED))}) THEN '=' || x ELSE x END)"
    return f"list_transform({out}, lambda x: ltrim(replace(x, 'Y', 'y'), '='))"
