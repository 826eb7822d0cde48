"""Prompts of question-answering benchmarks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts in each language.
PROMPTS = {
    "english": "Directly answer the best option:",
    "pubmedqa": "Directly answer yes/no/maybe:",
    "hindi": "सीधे सबसे अच्छे विकल्प के साथ जवाब दें:",
    "french": "Répondez directement avec la meilleure option:",
    "spanish": "Responde directamente con la mejor opción:",
    "chinese": "直接回答最优选项:",
}
ONE_SHOT = """Directly answer the best option in the following format: "Correct option is [option]. [answer]."
During periradicular surgery bone is removed with?
A. Double inverted cone burr 
B. Round burr
C. Fissure burr 
D. Taper Burr
Correct option is B. Round burr

"""
LEAD = "Correct option is"


def options(entries: Column) -> Column:
    """Lines "A. text" of an array of (letter, text)."""
    return F.array_join(F.transform(entries, lambda o: F.concat(o["letter"], F.lit(". "), o["text"], F.lit("\n"))), "")


def lettered(*texts: Column) -> Column:
    """An array of (letter, text), letters from A on."""
    return F.array(*(F.struct(F.lit(chr(65 + i)).alias("letter"), t.alias("text")) for i, t in enumerate(texts)))


def from_map(choices: Column, upper: bool = False) -> Column:
    """An array of (letter, text) of a map, in its own order."""
    return F.transform(F.map_entries(choices), lambda e: F.struct((F.upper(e["key"]) if upper else e["key"]).alias("letter"), e["value"].alias("text")))


def asked(question: Column, entries: Column) -> Column:
    """The English prompt, the question and its options, and the start of the answer."""
    return F.concat(F.lit(PROMPTS["english"] + "\n"), question, F.lit("\n"), options(entries), F.lit(LEAD))


def trailed(question: Column, entries: Column, language: str) -> Column:
    """The question and its options, then the prompt of a language."""
    return F.concat(question, F.lit("\n"), options(entries), F.lit(PROMPTS[language]))


def medqa(question: Column, choices: Column) -> Column:
    return asked(question, from_map(choices))


def mcq(question: Column, *texts: Column) -> Column:
    """GPQA, MMLU and MedMCQA: options by position."""
    return asked(question, lettered(*texts))


def pubmedqa(question: Column, contexts: Column) -> Column:
    return F.concat(F.lit("Abstract: "), F.array_join(contexts, "\n"), F.lit("\nQuestion: "), question, F.lit("\n" + PROMPTS["pubmedqa"]))


def usmle(question: Column, choices: Column) -> Column:
    """Options are in one text, marked (A) to (J)."""
    return F.concat(question, F.regexp_replace(choices, r"\(([A-J])\)", "\n$1."), F.lit("\n" + PROMPTS["english"]))


def medexpqa(question: Column, choices: Column, language: str = "english") -> Column:
    """Keys 1 to 5 are letters A to E; options "None" are left out; only three languages have a prompt."""
    entries = F.transform(F.map_entries(choices), lambda e: F.struct(F.translate(e["key"], "12345", "ABCDE").alias("letter"), e["value"].alias("text")))
    entries = F.filter(entries, lambda o: o["text"] != "None")
    prompt = PROMPTS[language] if language in ("english", "spanish", "french") else ""
    return F.concat(question, F.lit("\n"), options(entries), F.lit(prompt))


def mcmle(question: Column, choices: Column) -> Column:
    return trailed(question, from_map(choices), "chinese")


def cmmlu(question: Column, *texts: Column) -> Column:
    return trailed(question, lettered(*texts), "chinese")


def frenchmedmcqa(question: Column, choices: Column) -> Column:
    return trailed(question, from_map(choices, upper=True), "french")


def headqa(question: Column, answers: Column) -> Column:
    """The first four of an array of (atext)."""
    return trailed(question, lettered(*(F.get(answers, F.lit(i))["atext"] for i in range(4))), "spanish")


def led(generation: Column, family: Column, model: Column) -> Column:
    """A generation behind the lead that its prompt ended in, which models do not repeat: for GPQA only
    those of the path search were prompted so. A null generation is empty."""
    lead = F.when((family != "gpqa") | F.contains(model, F.lit("mcts")), F.lit(f"{LEAD} ")).otherwise(F.lit(""))
    return F.concat(lead, F.coalesce(generation, F.lit("")))


def letter_of(number: Column) -> Column:
    """1 to 4 as A to D, else null."""
    return F.get(F.array(*map(F.lit, "ABCD")), number - 1)


def yes_no_letter(decision: Column) -> Column:
    return F.when(decision == "yes", "A").when(decision == "no", "B").when(decision == "maybe", "C")


def shuffled_choices(item: Column, correct: Column, wrong: list[Column], seed: int = 42) -> tuple[Column, Column]:
    """(choices, letter): options in the order of a hash of seed, item and text, and the correct one's letter."""
    entries = F.array(*(F.struct(F.xxhash64(F.lit(seed), item, t, F.lit(i)).alias("k"), t.alias("t"), F.lit(i == 0).alias("right")) for i, t in enumerate([correct, *wrong])))
    ordered = F.array_sort(entries)
    place = F.array_position(F.transform(ordered, lambda e: e["right"]), True)
    return F.transform(ordered, lambda e: e["t"]), F.get(F.array(*map(F.lit, "ABCDEFGHIJ")), (place - 1).cast("int"))
