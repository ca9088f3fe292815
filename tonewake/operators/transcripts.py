"""Transcripts to chunks: sections, cleaning, speaker turns, chunks.

Everything is built from whole-text patterns and array functions, narrow and inside the JVM; the one shuffle is the removal of
duplicate transcripts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewake.functions import patterns as P
from tonewake.functions.text import bound, is_blank, sentences, strip, token_estimate
from tonewake.sources.shipping import ship

#: White space within a line, and the end of one.
_W, _END = r"[\s\x1c-\x1f&&[^\n]]", r"(?=\n|\z)"
AROUND_BREAK = rf"(?U){_W}*+\n{_W}*+"
FROM_FOOTER = rf"(?sU)(?:\A|\n){_W}*+" + P.FOOTER.replace("^", "").replace(r"\s*", f"{_W}*+") + r".*\z"
PREPARED_LINE = rf"(?U)\A{_W}*+{P.PREPARED_HEADER.replace('^', '').replace('$', '')}{_W}*+(?:\n|\z)"
QA_LINE = rf"(?U)(?:\A|\n){_W}*+{P.QA_HEADER.replace('^', '').replace('$', '')}{_W}*+{_END}"
#: A speaker's line: a name, then anything after ` -- `; an analyst's has three parts, the last of which says so.
_NAMED = rf"(?U:[^-\n][^\n]*? -- {_W}*+[^\n])"
_PART = rf"(?:(?! -- {_W}*+[^\n])[^\n])"
_ANALYST = rf"(?U:[^-\n]{_PART}* -- {_PART}*+ -- (?=[^\n]*{P.ANALYST}){_PART}++{_END})"
BEFORE_ANALYST = rf"(?U)\n(?={_W}*+{_ANALYST})"
_HEADER = rf"{_W}*+(?:{P.OPERATOR_LINE.replace('^', '').replace('$', '')}{_W}*+{_END}|(?=[^\n]{{1,{P.MAX_HEADER_CHARS - 1}}}?{_W}*+{_END}){_NAMED})"
BEFORE_HEADER = rf"(?U)\n(?={_HEADER})"
STARTS_WITH_HEADER = rf"(?U)\A{_HEADER}"

CHUNK_COLUMNS = ["ticker", "date", "fiscal_quarter", "exchange", "source_section", "speaker", "role", "chunk_text", "chunk_index", "chunk_token_count", "overlap"]


def longest_each(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The longest text of each key; null keys equal each other, and equal lengths go to the least text."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.length(text).desc_nulls_last(), F.col(text)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def first_each(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in the order of ordinal."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("__rank = 1").drop("__rank")


def with_sections(df: DataFrame, text: str = "transcript_text") -> DataFrame:
    """Adds prepared_remarks and qa_session: split at the first header line, else at the first analyst's line after some.

    Whole-text patterns do it, each run once over the text: a footer line and all after it go, then a leading header line, then
    the text falls into two at a Q&A header, or before the analyst's line in what follows the first lines."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), FROM_FOOTER, ""), PREPARED_LINE, "")
    df = df.withColumn("__body", body).withColumn("__halves", F.split("__body", QA_LINE, 2))
    head = F.substring_index("__body", "\n", P.MIN_PREPARED_LINES)
    rest = F.substr(F.col("__body"), F.length(head) + 1)
    later = F.split(rest, BEFORE_ANALYST, 2)
    by_analyst = F.array(F.concat(head, F.get(later, F.lit(0))), F.coalesce(F.get(later, F.lit(1)), F.lit("")))
    df = df.withColumn("__halves", F.when(F.size("__halves") == 2, F.col("__halves")).otherwise(by_analyst))
    return df.withColumn("prepared_remarks", strip(F.get("__halves", F.lit(0)))).withColumn("qa_session", strip(F.get("__halves", F.lit(1)))).drop("__body", "__halves")


def cleaned(x: Column) -> Column:
    """Without boilerplate phrases, with single blanks and single empty lines, and no line with white space at its ends."""
    for pattern in P.BOILERPLATE:
        x = F.regexp_replace(x, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, AROUND_BREAK, "\n"), "  +", " "), "\n{3,}", "\n\n"))


def role(title: Column, third: Column) -> Column:
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(third, F.lit("")))
    return (
        F.when(F.coalesce(third, F.lit("")).rlike(P.ANALYST), "analyst")
        .when(both.rlike(P.CEO), "ceo")
        .when(both.rlike(P.CFO), "cfo")
        .when(both.rlike(P.INVESTOR_RELATIONS), "ir")
        .when(both.rlike(P.ANALYST), "analyst")
        .otherwise("executive")
    )


def turns(x: Column) -> Column:
    """The speaker turns of a section, an array of (speaker, role, text); text before the first header is Unknown's.

    One split before all header lines gives the turns; what a header says is read once a turn."""

    def turn(block: Column) -> Column:
        def read(line: Column) -> Column:
            headed, operator = block.rlike(STARTS_WITH_HEADER), line.rlike(P.OPERATOR_LINE)
            parts = F.transform(F.split(line, " -- "), strip)
            said = F.when(headed, F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)).otherwise(block)
            return F.struct(
                F.when(~headed, "Unknown").when(operator, "Operator").otherwise(F.get(parts, F.lit(0))).alias("speaker"),
                F.when(~headed, "unknown").when(operator, "operator").otherwise(role(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).alias("role"),
                strip(said).alias("text"),
            )

        return F.get(F.transform(F.array(strip(F.substring_index(block, "\n", 1))), read), F.lit(0))

    return F.filter(F.transform(F.split(x, BEFORE_HEADER), turn), lambda t: t["text"] != "")


def packed_sentences(x: Column, limit: int = P.MAX_TOKENS) -> Column:
    """Chunks of whole sentences within limit estimated tokens; a longer sentence is a chunk of its own.

    The fold runs over sizes alone and notes where chunks start; their sentences are joined afterwards."""
    start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("tokens"), F.lit(0).alias("n"))

    def step(a: Column, size: Column) -> Column:
        full = (a["n"] > 0) & (a["tokens"] + size > limit)
        return F.struct(F.when(full, F.array_append(a["at"], a["n"])).otherwise(a["at"]).alias("at"), F.when(full, size).otherwise(a["tokens"] + size).alias("tokens"), (a["n"] + 1).alias("n"))

    def pieces(parts: Column) -> Column:
        starts = F.aggregate(F.transform(parts, token_estimate), start, step, lambda a: F.array_append(a["at"], a["n"]))
        return F.get(F.transform(F.array(starts), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.array_join(F.slice(parts, i + 1, F.get(at, k + 1) - i), " "))), F.lit(0))

    return F.get(F.transform(F.array(sentences(x)), pieces), F.lit(0))


def chunks_of_turns(said: Column, limit: int = P.MAX_TOKENS) -> Column:
    """One chunk for a turn within limit, else its packed sentences; (speaker, role, chunk_text, chunk_token_count)."""

    def made(t: Column) -> Column:
        subs = F.when(token_estimate(t["text"]) <= limit, F.array(t["text"])).otherwise(packed_sentences(t["text"], limit))
        return F.transform(F.filter(subs, lambda s: ~is_blank(s)), lambda s: F.struct(t["speaker"].alias("speaker"), t["role"].alias("role"), strip(s).alias("chunk_text"), token_estimate(s).alias("chunk_token_count")))

    return F.flatten(F.transform(said, made))


#: Java's pattern for what Python's white space is.
_SENTENCE_END = P.SENTENCE_END.replace(r"\s", r"[\s\x1c-\x1f]")
_ENDS = re.compile(P.SENTENCE_END.replace("(?U)", ""))
def overlapping(text: str | None, limit: int = P.MAX_TOKENS) -> list[tuple[str, int]]:
    """Windows of whole sentences within limit tokens, each starting half a window after the last, to the very end; of one text."""
    parts = _ENDS.split((text or "").strip())
    sizes = np.maximum(1, np.rint(np.array([len(p) for p in parts]) / P.CHARS_PER_TOKEN)).astype(int)
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, i = [], 0
    while i < len(parts):
        end = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        piece = " ".join(parts[i:end]).strip()
        if piece:
            out.append((piece, int(total[end] - total[i])))
        i += max(1, (end - i) // 2)
    return out


def overlapping_chunks(x: Column, limit: int = P.MAX_TOKENS) -> Column:
    """overlapping() of a column, an array of (chunk_text, chunk_token_count), in the JVM a row at a time.

    A fold moves both ends of the window over the sizes alone: each step takes a sentence in or notes the window and drops its
    first half, so twice the sentences are steps enough.  The windows' texts are joined afterwards; sentences have no white space
    at their ends, so windows have none."""

    def spans(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("e"), F.lit(0).alias("tokens"), F.array().cast("array<struct<i:int,e:int,tokens:int>>").alias("out"))

        def step(a: Column, _: Column) -> Column:
            size = F.get(sizes, a["e"])
            taken = F.struct(a["i"].alias("i"), (a["e"] + 1).alias("e"), (a["tokens"] + size).alias("tokens"), a["out"].alias("out"))
            gone = F.greatest(F.lit(1), F.floor((a["e"] - a["i"]) / 2).cast("int"))
            dropped = F.aggregate(F.slice(sizes, a["i"] + 1, gone), F.lit(0), lambda t, v: t + v)
            noted = F.array_append(a["out"], F.struct(a["i"].alias("i"), a["e"].alias("e"), a["tokens"].alias("tokens")))
            closed = F.struct((a["i"] + gone).alias("i"), a["e"].alias("e"), (a["tokens"] - dropped).alias("tokens"), noted.alias("out"))
            more = (a["e"] == a["i"]) | (a["tokens"] + size <= limit)  # null beyond the last
            return F.when(a["i"] >= F.size(sizes), a).when(more, taken).otherwise(closed)

        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(sizes)), start, step, lambda a: a["out"])

    def pieces(parts: Column) -> Column:
        at = bound(F.transform(parts, token_estimate), spans)
        return F.transform(at, lambda w: F.struct(F.array_join(F.slice(parts, w["i"] + 1, w["e"] - w["i"]), " ").alias("chunk_text"), w["tokens"].alias("chunk_token_count")))

    return F.filter(bound(F.split(F.btrim(F.coalesce(x, F.lit("")), F.lit(P.WHITE_SPACE)), _SENTENCE_END), pieces), lambda c: c["chunk_text"] != "")


def with_turns(df: DataFrame) -> DataFrame:
    """A row for each section, with source_section and its turns (none for a blank one); prepared_remarks and qa_session go."""
    named = F.array(*[F.struct(F.lit(s).alias("source_section"), F.col(s).alias("section")) for s in ("prepared_remarks", "qa_session")])
    rows = df.withColumn("__s", F.explode(F.filter(named, lambda s: s["section"] != ""))).drop("prepared_remarks", "qa_session")
    return rows.withColumn("source_section", F.col("__s.source_section")).withColumn("turns", turns(cleaned(F.col("__s.section")))).drop("__s")


def chunk_transcripts(transcripts: DataFrame, limit: int = P.MAX_TOKENS) -> DataFrame:
    """The chunks of both strategies, of the longest transcript of each (ticker, date).

    Sections are read once: both strategies' chunks are arrays of one row, and one explode gives the rows."""
    ship(transcripts.sparkSession)
    said = with_turns(with_sections(longest_each(transcripts, ["ticker", "date"], "transcript_text")))
    keep = ["ticker", "date", "fiscal_quarter", "exchange", "source_section"]
    mixed = F.lit("mixed")
    plain = F.transform(chunks_of_turns(F.col("turns"), limit), lambda c, k: F.struct(c["speaker"].alias("speaker"), c["role"].alias("role"), c["chunk_text"].alias("chunk_text"), k.alias("chunk_index"), c["chunk_token_count"].alias("chunk_token_count"), F.lit(False).alias("overlap")))
    over = F.transform("__over", lambda c, k: F.struct(mixed.alias("speaker"), mixed.alias("role"), c["chunk_text"].alias("chunk_text"), k.alias("chunk_index"), c["chunk_token_count"].alias("chunk_token_count"), F.lit(True).alias("overlap")))
    whole = said.withColumn("__over", overlapping_chunks(F.array_join(F.transform("turns", lambda t: t["text"]), " ")))
    return whole.select(*keep, F.explode(F.concat(plain, over)).alias("c")).select(*keep, "c.*").select(*CHUNK_COLUMNS)


def call_timing(raw: DataFrame) -> DataFrame:
    """raw: ticker, date (array of strings), ordinal.  One row for each (ticker, call_date): whether the call was after the close; unknown times are.

    The row of least ordinal (null first; of equal ones one before the close) decides, by least ordinals in one hash aggregation
    without a sort.  Undated rows go after it: a filter on the date would go below it and parse every date twice."""
    from tonewake.functions.text import call_minutes, date_string, parsed_date

    rows = raw.select(F.upper(strip(F.col("ticker"))).alias("ticker"), parsed_date(date_string(F.col("date"))).alias("call_date"), F.coalesce(call_minutes(F.col("date")) >= P.MARKET_CLOSE_MINUTES, F.lit(True)).alias("after_close"), "ordinal")
    late, number = F.col("after_close"), F.col("ordinal")
    least = rows.groupBy("ticker", "call_date").agg(F.min(F.when(late, number)).alias("__late"), F.min(F.when(~late, number)).alias("__early"), F.min(F.when(number.isNull(), late)).alias("__unnumbered"), F.count("call_date").alias("__dated"))
    after = F.coalesce("__unnumbered", F.col("__early").isNull() | F.coalesce(F.col("__late") < F.col("__early"), F.lit(False)))
    return least.where("__dated > 0").select("ticker", "call_date", after.alias("after_close"))
