r"""Quality rules, line first: each line must pass the punctuation, navigation and boilerplate rules; failing lines go, and a
document that loses too much of its text goes as a whole.

Defined results: a null or empty text has no words, fails the base rules and is not kept; its cleaned text is empty.  Lines
without a word are neither judged nor counted.  Each row is judged alone, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: A line without an end mark passes if it has so many words: it may be a long sentence that was cut.
LONG_LINE = 12
#: Share of a line's words that may carry symbols, separate links, or shout.
MAX_SHARE = 0.3
#: Share of a document's words that may go with failing lines.
MAX_LOST = 0.5
MIN_WORDS = 50
MAX_REPEAT = 0.5

# Our choices: end marks, and phrases of site furniture.
END_MARK = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*\s*$")
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings|consent)|enable javascript|lorem ipsum"
    r"|click here|sign in to|log ?in to|subscribe (?:now|to our)|share (?:on|via) (?:facebook|twitter)|skip to (?:main )?content"
)
BOILERPLATE_HINT = re.compile(r"(?i)reserved|terms|privacy|cookie|javascript|lorem|click|sign in|log ?in|subscribe|share|skip to")
#: Phrases of German, French and Spanish site furniture, for corpora that hold such texts.
OTHER_LANGUAGES = re.compile(
    r"(?i)alle rechte vorbehalten|nutzungsbedingungen|datenschutz(?:erklärung|richtlinie)|cookie-?(?:richtlinie|einstellungen)|hier klicken|jetzt abonnieren|newsletter abonnieren|zum inhalt springen"
    r"|tous droits réservés|conditions (?:générales )?d.utilisation|politique de confidentialité|politique de cookies|cliquez ici|abonnez-vous|partager sur (?:facebook|twitter)|aller au contenu"
    r"|todos los derechos reservados|términos (?:y condiciones|de uso|de servicio)|política de (?:privacidad|cookies)|ha(?:z|ga) clic aquí|suscríbete|iniciar? sesión|compartir en (?:facebook|twitter)|saltar al contenido"
)
SEPARATORS = frozenset(["|", "»", "›", ">", "•", "·", "/", "::"])
SYMBOL_WORD = re.compile(r"[#*$%&|<>~^=_]{2,}")

COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines", "long"), ("n_failed_lines", "long"), ("words_left", "long")]


def failed_rule(line: str, also: re.Pattern | None = None) -> str | None:
    """The first rule that the line fails; also: further phrases of boilerplate."""
    if BOILERPLATE_HINT.search(line) and BOILERPLATE.search(line) or also is not None and also.search(line):
        return "boilerplate"
    words = line.split()
    if "|" in line or "»" in line or "›" in line or "•" in line or "·" in line or ">" in line:
        if sum(w in SEPARATORS for w in words) > 0.1 * len(words):
            return "navigation"
    if SYMBOL_WORD.search(line) and sum(1 for w in words if SYMBOL_WORD.search(w)) > MAX_SHARE * len(words):
        return "punctuation"
    if "!!" in line and line.count("!!") > MAX_SHARE * len(words):
        return "punctuation"
    if len(words) < LONG_LINE and not END_MARK.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in width-word windows that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, width):
        if len(numbers) > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(numbers) + ids[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def judge(text: str | None, also: re.Pattern | None = None) -> tuple[tuple, str]:
    """The values of COLUMNS, and the cleaned text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > 50 * n
    seen: set[str] = set()
    duplicates = lines = failed = left = 0
    keep: list[str] = []
    for line in text.split("\n"):
        count = len(line.encode("utf-8", "surrogatepass").split())
        if not count:
            continue
        lines += 1
        duplicates += line in seen
        seen.add(line)
        if failed_rule(line, also):
            failed += 1
        else:
            left += count
            keep.append(line)
    kept = not base_failed and left >= (1 - MAX_LOST) * n
    blank = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (n, len(text) - blank, symbols, duplicates, repeats, base_failed, kept, lines, failed, left), "\n".join(keep)


def quality(docs: DataFrame, carry: list[str], cleaned: bool = False, also: re.Pattern | None = None) -> DataFrame:
    """Columns carry of docs with COLUMNS, and clean_text if cleaned; inputs named like an output are replaced.

    also: further phrases of boilerplate, such as OTHER_LANGUAGES."""
    ship(docs.sparkSession)
    outputs = {c for c, _ in COLUMNS} | ({"clean_text"} if cleaned else set())
    kept = [f for f in docs.schema.fields if f.name in carry and f.name not in outputs]
    types = {"long": (T.LongType(), pa.int64()), "boolean": (T.BooleanType(), pa.bool_())}
    schema = T.StructType([*kept, *(T.StructField(c, types[k][0]) for c, k in COLUMNS), *([T.StructField("clean_text", T.StringType())] if cleaned else [])])

    def run(batches):
        for batch in batches:
            rows = [judge(x.as_py(), also) for x in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([r[0][i] for r in rows], types[k][1]) for i, (_, k) in enumerate(COLUMNS)]
            if cleaned:
                columns.append(pa.array([r[1] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f.name) for f in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
