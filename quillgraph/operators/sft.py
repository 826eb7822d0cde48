"""Fine-tuning data: parsing and filtering samples, chat templates, masks, padding, splits, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.arrays import last, pad_left, pad_right
from quillgraph.tables import places, strung


def first_paragraph(text: Column) -> Column:
    """What stands before the first blank line, line breaks at the ends cut."""
    return F.get(F.split(F.trim(text, F.lit("\n")), "\n\n"), F.lit(0))


def parse_sample(text: Column, strict: bool = True) -> tuple[Column, Column]:
    """(question, answer) of "Question: ... Answer: ...", white space at the ends cut.

    ``strict``: null if a marker is missing. Otherwise offsets are taken as if a
    missing marker stood at -1: the question starts at place 9 and ends before the
    last character, the answer starts at place 7.
    """
    q, a, n = F.locate("Question: ", text) - 1, F.locate("Answer: ", text) - 1, F.length(text)
    end = F.when(a < 0, n - 1).otherwise(a)
    spaces = F.lit(" \t\n\r\x0b\x0c")
    question = F.trim(F.substring(text, q + 11, F.greatest(end - (q + 10), F.lit(0))), spaces)
    answer = F.trim(F.substring(text, a + 9, n), spaces)
    if strict:
        question, answer = F.when((q >= 0) & (a >= 0), question), F.when((q >= 0) & (a >= 0), answer)
    return question, answer


def clean_question(text: Column) -> Column:
    return F.translate(text, "<>", "")


def clean_answer(text: Column) -> Column:
    """Full stops at the ends go first, then angle brackets."""
    return F.translate(F.trim(text, F.lit(".")), "<>", "")


def conversation(question: Column, answer: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", question), turn("assistant", answer))


def is_entity(text: Column) -> Column:
    """At most eight words, no comma or line break, and no "x is a y"."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return (words <= 8) & ~F.rlike(text, F.lit("[,\n]")) & ~F.rlike(text, F.lit(r"(?U)\w+ is a \w+"))


def filter_report(df: DataFrame, passes: Column) -> DataFrame:
    """One row: total, passed, rate (null for an empty input)."""
    ok = F.coalesce(passes.cast("long"), F.lit(0))
    return df.agg(F.count("*").alias("total"), F.coalesce(F.sum(ok), F.lit(0)).cast("long").alias("passed"), F.avg(ok).alias("rate"))


# The chat templates by model family; an assistant's turn is (header, text, tail).
TEMPLATES = {
    "qwen": {"user": ("<|im_start|>user\n", "<|im_end|>\n"), "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n", "\n")},
    "llama": {"user": ("<|start_header_id|>user|end_header_id|>\n\n", "<|eot_id|>"), "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "\n")},
    "baichuan": {"user": ("<|start_header_id|>user|end_header_id|>\n\n", "<|eot_id|>"), "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "\n")},
    "mistral-7b": {"user": ("<s>[INST] ", " [/INST] "), "assistant": ("", "</s>", "\n")},
}


def family(model_name: str) -> str:
    """The template that a model's name asks for."""
    return next((f for f in TEMPLATES if f in model_name.lower()), "")


def render(messages: Column, model: str, eos: str = "<eos>") -> Column:
    """A session's (text, learn) segments: prompts are not learnt from, an assistant's text is,
    with its end, the end-of-sequence token and a line break. System prompts are never
    emitted; turns of users are those of role user or human."""
    t = TEMPLATES[model]
    segment = lambda text, learn: F.struct(text.alias("text"), F.lit(learn).alias("learn"))

    def turn(m: Column) -> Column:
        asked = F.array(segment(F.concat(F.lit(t["user"][0]), m["content"], F.lit(t["user"][1])), 0))
        header, end, tail = t["assistant"]
        said = [segment(F.concat(m["content"], F.lit(end + eos + tail)), 1)]
        if header:
            said.insert(0, segment(F.lit(header), 0))
        return F.when(F.lower(m["role"]).isin("user", "human"), asked).otherwise(F.array(*said))

    return F.flatten(F.transform(messages, turn))


def words(text: Column) -> Column:
    """The stand-in tokenizer: white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens_and_mask(segments: Column, tokenize: Callable[[Column], Column] = words) -> tuple[Column, Column]:
    """Tokens of all segments and, for each, whether it is learnt from."""
    tokens = F.flatten(F.transform(segments, lambda s: tokenize(s["text"])))
    mask = F.flatten(F.transform(segments, lambda s: F.array_repeat(s["learn"], F.size(tokenize(s["text"])))))
    return tokens, mask


def pad_batch(df: DataFrame, max_length: int, pad, tokens: str = "tokens", mask: str = "mask", batch: str | None = None) -> DataFrame:
    """The last ``max_length`` tokens, padded on the right: to ``max_length``, or to the longest of
    each ``batch``; masks with 0."""
    df = df.withColumns({tokens: last(F.col(tokens), max_length), mask: last(F.col(mask), max_length)})
    width = F.lit(max_length) if batch is None else F.max(F.size(tokens)).over(Window.partitionBy(batch))
    df = df.withColumn("_width", width)
    return df.withColumns({tokens: pad_right(F.col(tokens), F.col("_width"), F.lit(pad)), mask: pad_right(F.col(mask), F.col("_width"), F.lit(0))}).drop("_width")


def prompt_tokens(tokens: Column, max_length: int) -> Column:
    """A prompt for generation: its last ``max_length`` - 1 tokens, last first."""
    return F.reverse(last(tokens, max_length - 1))


def flip_pad(reversed_tokens: Column, width: Column, pad: Column) -> Column:
    """Padded at the end and turned round: padding in front of the prompt."""
    return pad_left(F.reverse(reversed_tokens), width, pad)


def preference_rows(df: DataFrame) -> DataFrame:
    """(pair, kind, text): chosen and rejected answers of complete rows, as one column."""
    full = df.where(F.col("prompt").isNotNull() & F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    side = lambda kind: full.select("pair", F.lit(kind).alias("kind"), F.concat("prompt", kind).alias("text"))
    return side("chosen").unionAll(side("rejected"))


def split_bounds(fractions: str, n: int) -> list[int]:
    """Bounds of the parts of n rows for fractions such as "2,4,4": cumulative rounding (half to
    even); what is too much at the end is taken from every bound but the first."""
    parts = [float(x) for x in fractions.split(",")]
    bounds = [0]
    for x in parts:
        bounds.append(bounds[-1] + round(x / sum(parts) * n))
    over = bounds[-1] - n
    return [0, *(b - over for b in bounds[1:])]


def split(df: DataFrame, fractions: str, order: list[Column]) -> DataFrame:
    """Adds part (from 0) by each row's place in ``order``, which should be that of a hash or an id."""
    bounds = split_bounds(fractions, df.count())
    part = F.lit(None).cast("int")
    for k in reversed(range(len(bounds) - 1)):
        part = F.when((F.col("_place") >= bounds[k]) & (F.col("_place") < bounds[k + 1]), k).otherwise(part)
    return places(df, order, "_place").withColumn("part", part).drop("_place")


def blend(sources: dict[str, DataFrame], seed: int = 42) -> DataFrame:
    """Rows of all sources with source_id and a shuffled order key, the same in every run."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.struct(*out.columns)))


#: Blocks' worth of tokens that rows are strung together to before they are cut.
STRUNG = 64


def pack(df: DataFrame, key: str, tokens: str | Column, block: int) -> DataFrame:
    """(block_no, tokens): all tokens, a column of arrays, in order of ``key``, cut into blocks; a last part of a block is
    dropped unless it is all there is.

    Rows are strung together as the sort's partitions go by; their places among all tokens say which blocks they hold
    whole, so only what is over at the ends of these runs is shuffled to meet. With an expression for ``tokens`` it is worked out after the sort.
    """
    runs, total = strung(df, [F.col(key)], F.col(tokens) if isinstance(tokens, str) else tokens, STRUNG * block)
    start, end = F.col("start"), F.col("start") + F.size("items")
    first, last_ = F.floor(start / block), F.floor((end - 1) / block)
    whole = lambda k: (k * block >= start) & ((k + 1) * block <= end)

    def cut(numbers: Column) -> DataFrame:
        begin = lambda k: F.greatest(start, k * block)
        piece = lambda k: F.slice("items", (begin(k) - start + 1).cast("int"), (F.least(end, (k + 1) * block) - begin(k)).cast("int"))
        pieces = F.transform(numbers, lambda k: F.struct(k.alias("block_no"), begin(k).alias("at"), piece(k).alias("piece")))
        return runs.select(F.explode(pieces).alias("p")).select("p.*")

    inner = cut(F.filter(F.sequence(first, last_), whole)).select("block_no", F.col("piece").alias("tokens"))
    ends = cut(F.filter(F.array_distinct(F.array(first, last_)), lambda k: ~whole(k)))
    met = ends.groupBy("block_no").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])).alias("tokens"))
    return inner.unionAll(met if total < block else met.where(F.size("tokens") == block))


def mini_batches(df: DataFrame, order: str, buffer: int, size: int, place: Column | None = None) -> DataFrame:
    """Adds buffer_no and batch_no: rows in order fill buffers, which are cut into small batches. With ``place`` rows
    say themselves where they stand (from 0), so ids that leave gaps or begin anew need no sort."""
    placed = places(df, [F.col(order)], "_n") if place is None else df.withColumn("_n", place)
    return placed.withColumns({"buffer_no": F.floor(F.col("_n") / buffer), "batch_no": F.floor((F.col("_n") % buffer) / size)}).drop("_n")


def trim_output(text: Column) -> Column:
    """A generation without its end markers."""
    return F.regexp_replace(text, r"<\|im_end\|>\n<\|endoftext\|>", "")


def instruction_prompt(instruction: Column) -> Column:
    """The prompt under which a fine-tuned model is tried on an instruction."""
    return F.concat(F.lit("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


# Special tokens of a tokenizer that has none of its own.
SPECIAL_TOKENS = {"pad_token": "[PAD]", "eos_token": "</s>", "bos_token": "<s>", "unk_token": "<unk>", "mask_token": "[MASK]"}


def special_tokens(df: DataFrame) -> DataFrame:
    """Rows of tokenizers' metadata with defaults for special tokens that are null, empty or no
    column, and added, the names of those that were."""
    own = {k: F.nullif(F.col(k), F.lit("")) if k in df.columns else F.lit(None).cast("string") for k in SPECIAL_TOKENS}
    added = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(k)) for k, c in own.items())))
    return df.withColumns({"added": added, **{k: F.coalesce(c, F.lit(SPECIAL_TOKENS[k])) for k, c in own.items()}})
