"""Text expressions: sentences, numbered answers, ratings, question-answer parsing, chunking."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.draws import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Abbreviations whose dot ends no sentence, and the marks that do end one.
ABBREVIATIONS = "(max|eg|Mrs|Dr|Mr)\\."
SENTENCE_MARKS = "[.!?。！？,;，；](?!\\d)"
PERIOD_MARKS = "[.。](?!\\d)"
NUMBER = "-?\\d+\\.?\\d*"


def _split_at(text, marks) -> Column:
    guarded = F.regexp_replace(_c(text), ABBREVIATIONS, "$1<DOT>")
    pieces = F.transform(F.split(guarded, marks, -1), lambda s: F.replace(trim_space(s), F.lit("<DOT>"), F.lit(".")))
    return F.filter(pieces, lambda s: s != "")


def trim_space(text) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_c(text), F.lit(" \t\n\x0b\f\r"))


def sentences(text) -> Column:
    """Non-empty clauses; a mark before a digit does not split."""
    return _split_at(text, SENTENCE_MARKS)


def period_sentences(text) -> Column:
    return _split_at(text, PERIOD_MARKS)


def first_number(text) -> Column:
    return F.regexp_extract(_c(text), NUMBER, 0).try_cast("double")


def metric_key(name) -> Column:
    return F.lower(F.regexp_replace(_c(name), "[^\\u4e00-\\u9fa5a-zA-Z]", ""))


def names_metric(metric, text) -> Column:
    """Whether the text mentions the metric, compared by letters only."""
    return F.contains(metric_key(text), metric_key(metric))


def relative_score(said, true) -> Column:
    """1 minus the relative error, kept in [0, 1]; near zero the answer only has to be near zero."""
    said, true = _c(said), _c(true)
    near = F.when(F.abs(said) < 0.5, 1.0).otherwise(0.0)
    close = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(said - true) / F.abs(true)))
    return F.when(F.abs(true) < 0.5, near).otherwise(close)


def numbered_answers(answer, n) -> Column:
    """Exactly ``n`` answers out of ``1. ... 2. ...``; missing ones are empty strings."""
    answer, n = _c(answer), _c(n)
    lines = F.regexp_extract_all(answer, F.lit("(?sm)(?:^|\\n).*?\\d+\\.\\s*(.*?)(?=\\n.*?\\d+\\.|$)"), F.lit(1))
    mark = lambda i: F.concat(i.cast("string"), F.lit(". "))
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.instr(answer, mark(i)))
    stop = lambda i: F.when(i < n, F.get(at, i)).otherwise(F.length(answer) + 1)
    cut = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(
            answer,
            F.get(at, i - 1) + F.length(mark(i)),
            F.greatest(F.lit(0), stop(i) - F.get(at, i - 1) - F.length(mark(i))),
        ),
    )
    found = F.size(lines)
    inline = (n > 1) & (found == 1) & F.forall(at, lambda p: p > 0)
    whole = (n == 1) & (found >= 1) & (trim_space(F.get(lines, F.lit(0))) == "")
    got = F.when(inline, cut).when(whole, F.array(F.regexp_replace(answer, "\\s+$", ""))).otherwise(lines)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(got, i - 1), F.lit("")))


def first_braces(text) -> Column:
    """The first balanced ``{...}`` of a text, NULL when there is none."""
    text = _c(text)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(0).alias("to"))

    def step(s, ch):
        i = s["i"] + 1
        opens = (ch == "{") & (s["to"] == 0)
        closes = (ch == "}") & (s["to"] == 0) & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        return F.struct(
            depth.alias("depth"),
            i.alias("i"),
            F.when(opens & (s["from"] == 0), i).otherwise(s["from"]).alias("from"),
            F.when(closes & (depth == 0), i).otherwise(s["to"]).alias("to"),
        )

    done = F.aggregate(F.split(text, ""), start, step)
    return F.when(done["to"] > 0, F.substring(text, done["from"], done["to"] - done["from"] + 1))


def strip_fences(text) -> Column:
    """Content of a fenced code answer, the text itself when it is not fenced."""
    text = _c(text)
    inside = F.when(text.startswith("```json"), F.substring(text, F.lit(8), F.length(text) - 10)).otherwise(
        F.substring(text, F.lit(4), F.length(text) - 6)
    )
    return F.when(text.startswith("```") & text.endswith("```"), trim_space(inside)).otherwise(text)


PIECES = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++"""


def _json_piece(piece: Column) -> Column:
    """A piece of a Python literal in JSON: a string in either quotes, or what stands between strings."""
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    string = F.concat(F.lit('"'), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    between = piece
    for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
        between = F.regexp_replace(between, f"\\b{python}\\b", json)
    between = F.regexp_replace(F.translate(between, "()", "[]"), r",\s*([\]}])", "$1")
    return F.when(F.startswith(piece, F.lit("'")), string).when(F.startswith(piece, F.lit('"')), piece).otherwise(between)


def tolerant_json(text) -> Column:
    """JSON, or a Python literal (either quotes, tuples, True/False/None), as VARIANT; NULL when neither."""
    plain = strip_fences(text)
    python = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(PIECES), F.lit(0)), _json_piece), "")
    return F.coalesce(F.try_parse_json(plain), F.try_parse_json(python))


# Ratings -----------------------------------------------------------------------------------


def faithfulness(text) -> Column:
    """1 when the answer field says yes."""
    bold = F.regexp_extract(_c(text), "\\*\\*Answer:\\*\\*\\s*(\\w+)", 1)
    plain = F.regexp_extract(_c(text), "Answer:\\s*(\\w+)", 1)
    return (F.lower(F.when(bold != "", bold).otherwise(plain)) == "yes").cast("int")


def relevancy(text) -> Column:
    """1 when the total score is two out of two."""
    return (F.regexp_extract(_c(text), "Total Score: (\\d)/2", 1) == "2").cast("int")


def verification(text) -> Column:
    """The number after ``Rating:``, 0 when there is none."""
    return F.coalesce(F.regexp_extract(_c(text), "Rating:\\s+(\\d+)", 1).try_cast("int"), F.lit(0))


def bracket_rating(text) -> Column:
    """The number in ``[[x]]``, else in ``[x]``; -1 without a rating."""
    text = _c(text)
    double = F.regexp_extract(text, "\\[\\[(\\d+\\.?\\d*)\\]\\]", 1).try_cast("double")
    single = F.regexp_extract(text, "\\[(\\d+\\.?\\d*)\\]", 1).try_cast("double")
    return F.when(F.contains(text, F.lit("Rating")), F.coalesce(double, single, F.lit(-1.0))).otherwise(-1.0)


def passes(rule: str, text) -> Column:
    """Named pass rules over a judge's text."""
    rules = {
        "faithful": lambda: faithfulness(text) == 1,
        "relevant": lambda: relevancy(text) == 1,
        "verified": lambda: verification(text) == 1,
        "good_question": lambda: bracket_rating(text) == 1,
        "good_answer": lambda: bracket_rating(text) > 1,
    }
    return rules[rule]()


def judged(df: DataFrame, rule: str, text: str) -> DataFrame:
    """Add ``is_valid`` and ``reason`` for one named pass rule."""
    ok = passes(rule, text)
    return df.withColumn("is_valid", ok).withColumn("reason", F.when(~ok, F.lit(f"failed {rule}")))


# Question-answer and instruction parsing ---------------------------------------------------


def qa_pairs(text) -> Column:
    """Question-answer structs out of ``[Question] ... [Answer] ... [End]``; an unfinished last pair is dropped."""
    text = _c(text)
    pieces = F.slice(F.split(text, "\\[Question\\]", -1), 2, 2_000_000_000)

    def pair(piece):
        at = F.instr(piece, "[Answer]")
        question = F.substring(piece, F.lit(1), at - 1)
        answer = F.substring(piece, at + 8, F.length(piece))
        return F.when(at > 0, F.struct(question.alias("q"), answer.alias("a")))

    pairs = F.filter(F.transform(pieces, pair), lambda p: p.isNotNull())
    ended = lambda s: F.contains(s, F.lit("[End]")) | F.contains(s, F.lit("[END]"))
    tail = F.element_at(pairs, -1)["a"]
    kept = F.when((F.size(pairs) > 1) & ~ended(tail), F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(pairs)
    tidy = lambda s: trim_space(F.regexp_replace(s, "\\[End\\]|\\[END\\]|\\[/INST\\]", ""))
    clean = F.transform(
        F.filter(kept, lambda p: ~ended(p["q"])),
        lambda p: F.struct(tidy(p["q"]).alias("question"), tidy(p["a"]).alias("answer")),
    )
    return F.filter(clean, lambda p: (p["question"] != "") & (p["answer"] != ""))


def explode_qa(df: DataFrame, text: str) -> DataFrame:
    """One row per parsed question-answer pair of a response that continues an open question."""
    pairs = qa_pairs(F.concat(F.lit("[Question]\n"), F.col(text)))
    got = df.select("*", F.posexplode(pairs).alias("pair_no", "_p")).drop(text)
    return got.select(*[c for c in got.columns if c != "_p"], "_p.question", "_p.answer")


def question_blocks(text) -> Column:
    """Non-empty texts between ``### Question n:`` heads."""
    return F.filter(F.transform(F.split(_c(text), "### Question \\d+:", -1), trim_space), lambda s: s != "")


def context_block(text) -> Column:
    """First text between the context marks, NULL when they are missing."""
    hit = F.regexp_extract_all(_c(text), F.lit("(?s)\\[Start of Context\\](.*?)(?=\\[End of Context\\])"), F.lit(1))
    return trim_space(F.get(hit, F.lit(0)))


def question_answer(text) -> Column:
    """Struct of the two halves of ``Question: ... Answer: ...``, NULL unless there is exactly one answer mark."""

    def both(halves):
        question = F.element_at(F.split(F.get(halves, F.lit(0)), "Question:", -1), -1)
        parts = F.struct(trim_space(question).alias("question"), trim_space(F.get(halves, F.lit(1))).alias("answer"))
        return F.when(F.size(halves) == 2, parts)

    return let(F.split(_c(text), "Answer:", -1), both)


# Instructions with one of these words are dropped.
DENIED_WORDS = [
    "image", "images", "graph", "graphs", "picture", "pictures", "file", "files", "map", "maps", "draw", "plot",
    "go to", "video", "audio", "music", "flowchart", "diagram",
]


def parse_instructions(df: DataFrame, text: str, first_no: int = 1) -> DataFrame:
    """One row per ``* Task n`` block with instruction, input, output and the reason it is dropped (or NULL)."""
    blocks = F.split(F.concat(F.lit(f"* Task {first_no}\n"), F.col(text)), "\\* Task \\d+", -1)
    rows = df.select("*", F.posexplode(F.filter(blocks, lambda b: trim_space(b) != "")).alias("task_no", "_b")).drop(text)
    fields = F.split("_b", "\\*\\*\\s+(?:Instruction|Input|Output):?", -1)
    rows = rows.withColumn("_f", fields)
    part = lambda i: trim_space(F.get("_f", F.lit(i)))
    rows = rows.withColumns({"instruction": part(1), "input": part(2), "output": part(3)})
    rows = rows.withColumn("input", F.when(F.lower("input") == "<noinput>", "").otherwise(F.col("input")))
    words = F.size(F.filter(F.split("instruction", "\\s+"), lambda w: w != ""))
    denied = F.col("instruction").rlike("(?i)\\b(" + "|".join(DENIED_WORDS) + ")\\b")
    reason = (
        F.when(F.size("_f") != 4, "format")
        .when((words <= 3) | (words > 150), "words")
        .when(denied, "denied word")
        .when(F.col("instruction").startswith("Write a program"), "program")
        .when(F.col("instruction").rlike("^\\p{Punct}"), "punctuation")
        .when(F.col("instruction").rlike("^[^\\x00-\\x7F]"), "non-ascii")
    )
    return rows.withColumn("reason", reason).drop("_b", "_f")


def example_text(instruction, given, output, number) -> Column:
    """One numbered example of a few-shot prompt."""
    head = F.regexp_replace(trim_space(F.regexp_replace(_c(instruction), "\\s+", " ")), ":+$", "")
    given = F.when(_c(given) == "", "<noinput>").otherwise(_c(given))
    return F.concat(
        F.lit("* Task "), _c(number).cast("string"), F.lit("\n** Instruction\n"), head,
        F.lit("\n** Input\n"), given, F.lit("\n** Output\n"), _c(output), F.lit("\n"),
    )


def few_shot_prompts(df: DataFrame, keys, order: str, head: str) -> DataFrame:
    """One prompt per group of examples; a group is the handful of examples of one prompt."""
    shots = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "instruction", "input", "output")))
    texts = F.transform(shots, lambda s, i: example_text(s["instruction"], s["input"], s["output"], i + 1))
    return df.groupBy(*keys).agg(
        F.concat(F.lit(head), F.array_join(texts, ""), F.lit("* Task "), (F.count("*") + 1).cast("string"), F.lit("\n")).alias("prompt")
    )


# Documents ---------------------------------------------------------------------------------


def without_references(text) -> Column:
    """The text up to its reference section."""
    text = _c(text)
    at = F.instr(text, "References")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def words_of(text) -> Column:
    return F.filter(F.split(_c(text), "\\s+"), lambda w: w != "")


def chunk_words(df: DataFrame, text: str, size: int, short_tail: int = 300) -> DataFrame:
    """Chunks of ``size`` words; a tail of at most ``short_tail`` words joins the chunk before it."""
    words = df.withColumn("_w", words_of(text)).drop(text)
    total = F.size("_w")
    full = F.floor(total / size).cast("int")
    rest = total % size
    merged = F.when((total <= size) | (full == 0), 1).when((rest > 0) & (rest > short_tail), full + 1).otherwise(F.greatest(full, F.lit(1)))
    if short_tail >= size:  # every chunk after the first counts as short
        merged = F.lit(1)
    rows = words.withColumn("_n", merged).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    last = F.col("chunk_no") == F.col("_n") - 1
    take = F.when(last, F.greatest(total - F.col("chunk_no") * size, F.lit(0))).otherwise(F.lit(size))
    piece = F.slice("_w", F.col("chunk_no") * size + 1, take)
    return rows.withColumn("content", F.array_join(piece, " ")).withColumn("document_len", F.size(piece)).drop("_w", "_n")


def flatten_texts(df: DataFrame, column: str, out="content") -> DataFrame:
    """Texts of a VARIANT that holds a text, a ``{content}`` object, or an array of either."""
    v = F.col(column)
    kind = F.schema_of_variant(v)
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.content", "string"), F.try_variant_get(x, "$", "string"))
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    texts = F.when(F.startswith(kind, F.lit("ARRAY")), many).otherwise(F.array(one(v)))
    return df.withColumn(out, F.explode(F.filter(texts, lambda s: s.isNotNull()))).drop(column)


# Conversations -----------------------------------------------------------------------------


def user_text(conversations: DataFrame) -> DataFrame:
    """User turns of a conversation joined by blank lines, trimmed."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    joined = F.array_join(F.transform(said, lambda s: s["text"]), "\n\n")
    return conversations.groupBy("conv_id").agg(trim_space(joined).alias("user_text"))


def numbered_dialogue(conversations: DataFrame) -> DataFrame:
    """A conversation as numbered user and assistant sections; other roles are left out.

    Turns of one conversation are few, so they fit one sorted array; turns are numbered
    per role by counting inside it.
    """
    kept = conversations.where(F.col("role").isin("user", "assistant"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = kept.groupBy("conv_id").agg(turns.alias("t"))

    def section(s):
        nth = F.size(F.filter("t", lambda o: (o["role"] == s["role"]) & (o["turn"] <= s["turn"]))).cast("string")
        label = F.when(s["role"] == "user", F.lit("### User Question: ")).otherwise(F.lit("### Assistant Response: "))
        return F.concat(F.lit("\n"), label, nth, F.lit("\n"), s["text"], F.lit("\n"))

    return grouped.select("conv_id", F.array_join(F.transform("t", section), "").alias("dialogue"))


# Roles that may speak, and those that count as the answering side.
SILENT_ROLES = ["system", "developer", "tool"]
ANSWERING_ROLES = ["assistant", "agent"]


def conversation_verdict(conversations: DataFrame) -> DataFrame:
    """Validity of long-form conversations: known roles, at least one user turn, equal sides when several."""
    known = ["user", *ANSWERING_ROLES, *SILENT_ROLES]
    said = F.length("text") > 0
    counts = conversations.groupBy("conv_id").agg(
        F.count_if(~F.coalesce(F.col("role").isin(known), F.lit(False))).alias("_odd"),
        F.count_if((F.col("role") == "user") & said).alias("n_user"),
        F.count_if(F.col("role").isin(ANSWERING_ROLES) & said).alias("n_answer"),
    )
    reason = (
        F.when(F.col("_odd") > 0, "unsupported role")
        .when(F.col("n_user") < 1, "no user turn")
        .when((F.col("n_user") > 1) & (F.col("n_user") != F.col("n_answer")), "unequal turns")
    )
    return counts.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).drop("_odd")


def turns_of(messages) -> Column:
    """Messages with free key names (array of string maps) as ``array<struct<role, text>>``."""
    role = lambda m: F.coalesce(m["from"], m["role"], m["speaker"])
    text = lambda m: F.coalesce(m["value"], m["content"], m["text"])
    return F.transform(_c(messages), lambda m: F.struct(role(m).alias("role"), text(m).alias("text")))


# Series in text ----------------------------------------------------------------------------


def splice_series(prompt, series, digits=3) -> Column:
    """Put rounded series into the ``<ts><ts/>`` slots; raises when the counts differ."""
    slots = F.split(_c(prompt), "<ts><ts/>", -1)
    shown = F.transform(
        _c(series),
        lambda s: F.concat(F.lit("<ts>["), F.array_join(F.transform(s, lambda v: F.format_string(f"%.{digits}f", v)), ", "), F.lit("]<ts/>")),
    )
    filled = F.zip_with(slots, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    wrong = F.raise_error(F.lit("the prompt has another number of slots than there are series")).cast("string")
    return F.when(F.size(slots) == F.size(_c(series)) + 1, F.array_join(filled, "")).otherwise(wrong)


def extract_series(text) -> Column:
    """All ``<ts>[...]<ts/>`` arrays of a text."""
    found = F.regexp_extract_all(_c(text), F.lit("<ts>(\\[[^\\]]*\\])<ts/>"), F.lit(1))
    return F.transform(found, lambda s: F.from_json(s, "array<double>"))


def blank_series(text) -> Column:
    return F.regexp_replace(_c(text), "<ts>\\[[^\\]]*\\]<ts/>", "<ts><ts/>")


def render(template) -> Column:
    """``{{field}}`` placeholders of a literal template replaced by columns; a dict of templates gives a struct."""
    import re

    if isinstance(template, dict):
        return F.struct(*[render(t).alias(name) for name, t in template.items()])
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fill_slots(rows: DataFrame, replies: DataFrame, key: str, text: str) -> DataFrame:
    """Replace numbered ``<|prompt n|>`` slots with the replies of the same key and number."""
    slot = "<\\|prompt (\\d+)\\|>"
    pieces = F.split(F.col(text), slot, -1)
    numbers = F.regexp_extract_all(F.col(text), F.lit(slot), F.lit(1))
    cut = rows.select("*", F.posexplode(F.arrays_zip(pieces.alias("p"), numbers.alias("n"))).alias("_i", "_z"))
    wanted = cut.withColumn("prompt_no", F.col("_z.n").try_cast("bigint"))
    joined = wanted.join(replies.select(key, "prompt_no", "reply"), [key, "prompt_no"], "left")
    keep = [c for c in rows.columns if c not in (key, text)]
    original = F.concat(F.lit("<|prompt "), F.col("_z.n"), F.lit("|>"))
    piece = F.concat(F.coalesce("_z.p", F.lit("")), F.when(F.col("_z.n").isNotNull(), F.coalesce("reply", original)).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), piece.alias("p"))))
    filled = F.array_join(F.transform(parts, lambda s: s["p"]), "").alias(text)
    return joined.groupBy(key, *keep).agg(filled)
