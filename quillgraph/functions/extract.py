"""The chosen option in a model's free answer.

Patterns are tried in order and the first that is found anywhere decides. They are
tables of templates. One scan of a text for the literals that templates cannot do
without says which patterns can match at all; the others are passed over. Arrow UDFs hold them
compiled once for each task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a letter, and the phrases in their order.
LETTERS = "一-鿿a-zA-ZÀ-ÖØ-öø-ÿÁÉÍÓÚÜáéíóúüÑñऀ-ॿ"
PHRASES = ("[cC]orrect answer is", "[cC]orrect option is", "[cC]orrect choice is", "[aA]nswer is", "[oO]ption is", "OPTION", "[cC]hoice is")
VERBS = ("is", "would", "could", "will")
COLON_NOUNS, BARE_NOUNS = ("[oO]ption:+", "[cC]hoice:+"), ("[cC]hoice", "[aA]nswer", "[Oo]ption")
GAP, WORDLESS = f"[^{LETTERS}]", f"[^{LETTERS}0-9]"  # not a letter; neither letter nor digit
BRACKETS = (r"\({}\)", r"\[{}\]", r"\{{{}\}}")


# The patterns in their order. {x} is an option, {v} an option but A, {g} no letter, {w} neither letter nor digit;
# {p} is a phrase, {V} a verb, {n} a noun of a list above, each of which takes its turn.
START = (r"^{x}\.",)
AFTER = (
    r"{p}{g}*\({x}\){g}", r"{p}{g}*\[{x}\]{g}", r"{p}{g}*\{{{x}\}}{g}", r"{p}{g}*{x}\){g}", r"{p}{g}*{x}{w}",
    r"{p}{g}*\({x}\)", r"{p}{g}*\[{x}\]", r"{p}{g}*\{{{x}\}}", r"{p}{g}*{x}\)", r"{p}{g}*{x}$",
)
AFTER_OPTION = (
    r"{p}{g}*\({x}\){g}IS CORRECT", r"{p}{g}*\[{x}\]{g}IS CORRECT", r"{p}{g}*\{{{x}\}}{g}IS CORRECT", r"{p}{g}*{x}\){g}IS CORRECT", r"{p}{g}*{x}{w}IS CORRECT",
    r"{p}{g}*\({x}\)IS CORRECT", r"{p}{g}*\[{x}\]IS CORRECT", r"{p}{g}*\{{{x}\}}IS CORRECT", r"{p}{g}*{x}\)IS CORRECT",
)
ANNOUNCED = (
    r"is{g}*:+{g}*\n+{g}*{x}\)", r"is{g}*\n+{g}*{x}\)",
    r"would be{g}*\({x}\){g}", r"would be{g}*\[{x}\]{g}", r"would be{g}*\{{{x}\}}{g}", r"would be{w}*{x}\){g}", r"would be{w}*{v}{w}",
    r"would be{g}*\({x}\)", r"would be{g}*\[{x}\]", r"would be{g}*\{{{x}\}}", r"would be{g}*{x}\)", r"would be{g}*{x}$",
    r"is{g}*:+{g}*\n+{g}*\({x}\)", r"is{g}*\n+{g}*\({x}\)", r"is{g}*:+{g}*\n+{g}*\[{x}\]", r"is{g}*\n+{g}*\[{x}\]",
    r"is{g}*:+{g}*\n+{g}*\{{{x}\}}", r"is{g}*\n+{g}*\{{{x}\}}", r"is{g}*:+{g}*\n+{g}*{x}\)", r"is{g}*\n+{g}*{x}\)",
)
WORD = (r"is{w}+{x}\)", r"be{w}+{x}\)")
BEFORE_VERB = (r"{w}+{x}\){g}*{V}",)
COLON_OR_END = (r":+{w}*{x}\){g}", r":+{w}*{x}\)$", r":+{w}*{x}\)", r"{w}+{x}\)$", r"{w}+{x}\){g}")
UNBALANCED_START = (r"^{w}*{x}\){g}*{V}",)
UNBALANCED_LINE = (r"^{g}*{w}{x}\)", r"^{w}*{x}\)", r":+{g}*\n+{g}*{x}\)")
UNBALANCED_VERB = (r"\n+{g}*{x}\){g}*{V}",)
UNBALANCED_END = (r"\n+{g}*{x}\){g}", r"\n+{g}*{x}\)$", r"\n+{g}*{x}\)")
ALONE = (r"^{w}*{x}{w}*$",)
VERB_AFTER = (r"\({x}\){g}*{V}", r"\[{x}\]{g}*{V}", r"\{{{x}\}}{g}*{V}", r"{w}{x}\){g}*{V}", r"{w}{x}{w}{g}*{V}", r"^{x}\){g}*{V}", r"^{x}{w}{g}*{V}")
NOUN = (
    r"{n}{g}*\({x}\)", r"{n}{g}*\[{x}\]", r"{n}{g}*\{{{x}\}}",
    r"{n}{w}*{x}\){w}", r"{n}{w}*{x}\)$", r"{n}{g}*{w}{x}\){w}", r"{n}{g}*{w}{x}\)$",
    r"{n}{w}*{x}{w}", r"{n}{w}*{x}$", r"{n}{g}*{w}{x}{w}", r"{n}{g}*{w}{x}$",
)
IS = (
    r" is{g}+\({x}\){g}", r" is{g}+\[{x}\]{g}", r" is{g}+\{{{x}\}}{g}", r" is{g}*{w}{x}\){g}",
    r" is{g}+\({x}\)$", r" is{g}+\[{x}\]$", r" is{g}+\{{{x}\}}$", r" is{g}*{w}{x}\)$", r" is{x}\){g}", r" is{x}\)$",
    r" is{g}*{w}{v}{w}", r" is{g}*{w}{x}$", r" is{v}{w}", r" is{x}$",
    r" is{g}+\({x}\)", r" is{g}+\[{x}\]", r" is{g}+\{{{x}\}}", r" is{g}*{w}{x}\)", r" is{w}*{x}\)",
)
SEVERAL = "[aA]{g}*[bB]{g}*[cC]{g}*[dD]"
CLOSE = (r"\({x}\)", r"\[{x}\]", r"\{{{x}\}}", r"{w}{v}{w}")
#: What a pattern cannot do without if its template has it: one look for each of these in a text spares most patterns.
LITERALS = ("orrect answer is", "orrect option is", "orrect choice is", "nswer is", "ption is", "hoice is", "OPTION", "IS CORRECT", "would", "could", "will", " is", "is", "be", "nswer", "ption", "hoice", ")", "]", "}", ":", "\n")


def needed(template: str) -> int:
    """Bits of the literals in a template. Templates hold no alternatives and no part that may be missing but classes, which stand in braces or brackets."""
    plain = template.replace(r"\n", "\n").replace(r"\{{", "").replace(r"\}}", "\1")
    for part in (r"\{\w\}[*+]?", r"(?<!\\)\[[^\]]*\]"):
        plain = re.sub(part, "\0", plain)
    plain = plain.replace("\\", "").replace("\1", "}")
    return sum(1 << i for i, literal in enumerate(LITERALS) if literal in plain)


class Patterns:
    """The ordered patterns for a range of options such as "a-dA-D"."""

    def __init__(self, options: str):
        high = options[-1].lower()
        self.values = {"x": f"([{options}])", "v": "([bA-B])" if high == "b" else f"([b-{high}A-{high.upper()}])", "g": GAP, "w": WORDLESS}
        each = lambda name, words, templates: [(t, {name: w}) for w in words for t in templates]
        plain = lambda templates: [(t, {}) for t in templates]
        said = [row for p in PHRASES for row in each("p", (p,), AFTER_OPTION if p == "OPTION" else AFTER)]
        self.announced = self._compiled([*plain(START), *said, *plain(ANNOUNCED + WORD), *each("V", VERBS, BEFORE_VERB), *plain(COLON_OR_END)])
        self.unbalanced = self._compiled([
            *each("V", VERBS, UNBALANCED_START), *plain(UNBALANCED_LINE), *each("V", VERBS, UNBALANCED_VERB), *plain(UNBALANCED_END + WORD), *each("V", VERBS, BEFORE_VERB), *plain(COLON_OR_END),
        ])
        self.further = self._compiled([*plain(ALONE), *each("V", VERBS, VERB_AFTER), *each("n", COLON_NOUNS, NOUN), *plain(IS), *each("n", BARE_NOUNS, NOUN)])
        self.several = re.compile(SEVERAL.format(**self.values))
        self.close = [re.compile(c.format(**self.values)) for c in CLOSE]

    def _compiled(self, rows: list[tuple[str, dict[str, str]]]) -> list[tuple[int, re.Pattern]]:
        """(literals needed, pattern) of each row; a word that takes its turn is part of what is needed."""
        spelled = [(t.replace("{p}", v.get("p", "")).replace("{V}", v.get("V", "")).replace("{n}", v.get("n", "")), t.format(**self.values, **v)) for t, v in rows]
        return [(needed(t), re.compile(p)) for t, p in spelled]

    def find(self, answer: str) -> str | None:
        answer = answer.replace("*", "\n")
        has = sum(1 << i for i, literal in enumerate(LITERALS) if literal in answer)
        stages = [self.announced, self.unbalanced if answer.count(")") > answer.count("(") else [], self.further]
        for needs, pattern in (row for stage in stages for row in stage):
            if needs & has == needs and (hit := pattern.search(answer)):
                return hit.group(1).upper()
        if self.several.search(answer):
            return None
        for i in range(len(answer) - 2):
            for pattern in self.close:
                if hit := pattern.search(answer[i : i + 3]):
                    return hit.group(1).upper()
        return None


@lru_cache(maxsize=16)
def patterns(options: str) -> Patterns:
    return Patterns(options)


def find_option(answer: str, options: str = "a-eA-E") -> str | None:
    return patterns(options).find(answer)


# Words of other languages and what stands for them, in the order of replacement. A
# rule whose text an earlier rule has already replaced never applies; the order is kept all the same.
CHINESE = [
    ("*", " "), (":", "\n\n"), ("（", "\n\n"), ("）", "\n\n"), ("(", "\n\n"), (")", "\n\n"),
    ("证属", " the correct answer is"), ("属于", " the correct answer is"), ("宜选", " the correct answer is"),
    ("选项是", " option is"), ("选择是", " choice is"), ("答案是", " answer is"), ("方法是", " answer is"),
    ("可能是", " would be"), ("应该是", " would be"), ("诊断是", " answer is"),
    ("选项为", " option is"), ("选择为", " choice is"), ("答案为", " answer is"),
    ("可能为", " would be"), ("应该为", " would be"), ("诊断为", " answer is"),
    ("最优选项", " correct answer is"), ("最好选项", " correct answer is"), ("最佳选项", " correct answer is"), ("正确选项", " correct answer is"),
    ("最优的选项", " correct answer is"), ("最好的选项", " correct answer is"), ("最佳的选项", " correct answer is"), ("正确的选项", " correct answer is"),
    ("是", " is"), ("为", " is"), ("选", " is"),
    ("最优的", " correct"), ("最佳的", " correct"), ("最好的", " correct"), ("正确的", " correct"),
    ("最优", " correct"), ("最佳", " correct"), ("最好", " correct"), ("正确", " correct"),
    ("选项", " option:\n\n"), ("选择", " choice:\n\n"), ("答案", " answer:\n\n"), ("诊断", " answer:\n\n"), ("项", " option:\n\n"),
    ("可能", " would "), ("也许", " could "),
]
CHINESE_MARKS = ("，。；：“”‘’（）【】《》？！—", ",.;:\"\"''()[]<>?!-")
FRENCH = [
    ("*", "\n"), ("'", ""), (" la ", " "), ("réponse", "answer"), ("correcte", "correct answer"), ("La bonne", "correct answer"),
    ("choix", "choice"), ("être", "be"), ("serait", "would be"), ("pourrait", "could"), ("est", "is"),
]
FRENCH_LETTERS = ("àâÀÂçÇéèêëÉÈÊË", "aaAAcCeeeeEEEE")
SPANISH = [
    ("*", "\n"), ("respuesta", "answer"), ("correcta", "correct answer"), ("correcto", "correct answer"), ("elección", "choice"),
    ("opción", "option"), ("haría", "would"), ("podría", "could"), ("es", "is"), ("ser", "be"),
]
HINDI = {"अ": "A", "ब": "B", "स": "C", "द": "D"}


def _replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        text = text.replace(old, new)
    return text


def find_chinese(answer: str, options: str = "a-eA-E") -> str | None:
    alone = answer.strip().upper()
    if alone in {"A", "B", "C", "D"}:
        return alone
    text = _replaced(answer, CHINESE).translate(str.maketrans(*CHINESE_MARKS)).replace("  ", " ")
    return find_option(re.sub("([一-鿿])", r"\1 ", text), options)


def find_french(answer: str, options: str = "a-eA-E") -> str | None:
    return find_option(_replaced(answer, FRENCH).translate(str.maketrans(*FRENCH_LETTERS)), options)


def find_spanish(answer: str, options: str = "a-eA-E") -> str | None:
    return find_option(_replaced(answer, SPANISH), options)


def find_hindi(answer: str, options: str = "a-eA-E") -> str | None:
    text = answer.upper().replace("*", "\n")
    return find_option(re.sub(r"(?<!\w)([अबसद])(?!\w)", lambda m: HINDI[m.group(0)], text, count=1), options)


# The patterns of yes, no and maybe in their order. {y}, {n} and {m} are the words, {g} no letter, {f} neither letter nor space; {N} is a noun.
DECISION_WORDS = {"y": "([yY][eE][sS])", "n": "([nN][oO])", "m": "([mM][aA][yY][bB][eE])"}
DECISION_LETTERS = {"YES": "A", "NO": "B", "MAYBE": "C"}
DECISION_NOUNS = ("[aA]nswer", "[oO]ption", "[cC]hoice")
ECHOES = ("^{y}/{n}/{m}", "^{y}/{n}")
AFTER_ECHO = ("^{g}*{y}", "^{g}*{n}", "^{g}*{m}")
DECISION_START = ("^{g}*{y}{g}", "^{g}*{n}{f}", "^{g}*{m}{f}")
DECISION_NOUN = (
    "{N} is{g}*{y}{f}", "{N} is{g}*{n}{f}", "{N} is{g}*{m}{f}", "{N}{g}*{y}{g}", "{N}{g}*{n}{f}", "{N}{g}*{m}{f}",
    "{N} is{g}*{y}{g}", "{N} is{g}*{n}{g}", "{N} is{g}*{m}{g}", "{N}{g}*{n}{g}", "{N}{g}*{m}{g}",
)
DECISION_WHOLE = ("^{g}*{y}$", "^{g}*{n}$", "^{g}*{m}$", "^{g}*{n}{g}", "^{g}*{m}{g}")
DECISION_ANYWHERE = (
    " is{g}*:+{g}*{y}{f}", " is{g}*:+{g}*{n}{f}", " is{g}*:+{g}*{m}{f}",
    r" is{g}*:+\s+{g}*{y}{g}", r" is{g}*:+\s+{g}*{n}{g}", r" is{g}*:+\s+{g}*{m}{g}",
    " is{g}*{y}{f}",
    ":+{g}*{y}{f}", ":+{g}*{n}{f}", ":+{g}*{m}{f}",
    r":+\s+{g}*{y}{g}", r":+\s+{g}*{n}{g}", r":+\s+[^a-zA-E]*{m}{g}",
    r" is{g}*\s+{g}*{y}{g}", " is{g}*{n}{f}", " is{g}*{m}{f}", r" is{g}*\s+{g}*{n}{g}", r" is{g}*\s+{g}*{m}{g}",
    "{g}{y}{f}", "{g}{m}{f}", "{g}{n}{f}", "{g}{y}$", "{g}{m}$", "{g}{n}$", "{g}{y}{g}", "{g}{m}{g}", "{g}{n}{g}",
    "{g}{y}{g}*", "{g}{m}{g}*", "{g}*{y}{g}*", "{g}*{m}{g}*",
)
DECISION_INSIDE = ("{n}[a-zA-Z]+", "[a-zA-Z]+{n}")
DECISION_LEFT = "{g}*{n}{g}*"


class Decision:
    """Yes, no or maybe as A, B or C, by ordered patterns."""

    def __init__(self) -> None:
        values = {**DECISION_WORDS, "g": "[^a-zA-Z]", "f": r"[^a-zA-Z\s]"}
        row = lambda t, noun="": ("{" + next(w for w in "ynm" if f"{{{w}}}" in t) + "}", re.compile(t.format(**values, N=noun)))
        rows = lambda templates: [row(t) for t in templates]
        self.echoes = [re.compile(t.format(**values)) for t in ECHOES]
        self.after_echo, self.start, self.whole, self.anywhere = rows(AFTER_ECHO), rows(DECISION_START), rows(DECISION_WHOLE), rows(DECISION_ANYWHERE)
        self.phrases = [row(t, noun) for noun in DECISION_NOUNS for t in DECISION_NOUN]
        self.inside = [re.compile(t.format(**values)) for t in DECISION_INSIDE]
        self.left = re.compile(DECISION_LEFT.format(**values))

    def find(self, answer: str) -> str | None:
        stages = [self.start, self.phrases, self.whole, self.anywhere]
        if self.echoes[0].search(answer):
            answer, stages = answer[len("yes/no/maybe") :], [self.after_echo, *stages]
        elif self.echoes[1].search(answer):
            answer = answer[len("yes/no") :]
        low = answer.lower()
        has = {"{y}": "yes" in low, "{n}": "no" in low, "{m}": "maybe" in low}
        for word, pattern in (r for stage in stages for r in stage):
            if has[word] and (hit := pattern.search(answer)):
                return DECISION_LETTERS[hit.group(1).upper()]
        if any(p.search(answer) for p in self.inside):
            return None
        return "B" if self.left.search(answer) else None


@lru_cache(maxsize=1)
def decision() -> Decision:
    return Decision()


def find_decision(answer: str) -> str | None:
    return decision().find(answer)


REMEMBERED = 10_000
FINDERS: dict[str, Callable[..., str | None]] = {"english": find_option, "chinese": find_chinese, "french": find_french, "spanish": find_spanish, "hindi": find_hindi}


def extract(answer: Column, options: str = "a-eA-E", language: str = "english") -> Column:
    """The option's letter, null if none is found or the answer is null."""
    find = FINDERS[language]
    return _each(answer, lambda a: find(a, options))


def extract_decision(answer: Column) -> Column:
    """Yes, no or maybe, null if none is found or the answer is null."""
    return _each(answer, find_decision)


def extract_by(answer: Column, family: Column, options: dict[str, str | None]) -> Column:
    """Each answer as its family reads it, by the range of options or, where that is None, as a decision; null for
    other families. One reader for all: a session starts a process for each that a plan has."""
    finders = {name: find_decision if o is None else (lambda a, o=o: find_option(a, o)) for name, o in options.items()}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = {name: lru_cache(REMEMBERED)(find) for name, find in finders.items()}
        for answers, families in batches:
            yield pd.Series([known[f](a) if a is not None and f in known else None for a, f in zip(answers, families, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(answer, family)


def _each(answer: Column, find: Callable[[str], str | None]) -> Column:
    """``find`` of each answer; a task remembers up to REMEMBERED answers, so what comes often is read once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = lru_cache(REMEMBERED)(find)
        for answers in batches:
            yield answers.map(lambda a: None if a is None else known(a))

    return F.pandas_udf(run, "string")(answer)


def extract_core(answer: Column, options: str = "a-dA-D") -> Column:
    """The commonest forms by expressions alone: "A." at the start, then "answer is", "option is"
    and "choice is" with the option in round brackets or bare."""
    one = f"([{options}])"
    forms = [rf"^{one}\."] + [f"{noun} is{GAP}*{form}" for noun in ("[aA]nswer", "[oO]ption", "[cC]hoice") for form in (rf"\({one}\)", f"{one}{WORDLESS}", f"{one}$")]
    return F.upper(F.coalesce(*(F.nullif(F.regexp_extract(answer, p, 1), F.lit("")) for p in forms)))


def with_options(prompt: Column, response: Column) -> Column:
    """The response, lower-cased if the prompt has options, with each option's text replaced by its line "X. text"."""
    lines = F.transform(F.array(*map(F.lit, "ABCDEFGHIJ")), lambda c: F.call_function("regexp_extract", prompt, F.concat(F.lit("("), c, F.lit(r"\.\s.*?)\n")), F.lit(1)))
    lines = F.filter(lines, lambda o: F.length(o) > 3)
    return F.aggregate(lines, response, lambda r, o: F.replace(F.lower(r), F.lower(F.substr(o, F.lit(4))), o))
