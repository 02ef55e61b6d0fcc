"""Column expressions on source text and on token text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, a word, a line mark and a flaw separator.
WHITESPACE = r"[\s\u000b\u001c-\u001f\u0085\p{Z}]+"
#: Letters, letter numbers, marks, decimal digits, connectors, joiners, and enclosed letters.
WORD_CHARS = (
    r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
    r"\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
)
WORD = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}\s\x{{0B}}\x{{85}}\p{{Z}}]+"
SPACE_MARK = "Ġ"
TAB_MARK = "ĉ"
LINE_MARK = "Ċ"
LINE_SEPARATORS = ["Ċ", " Ċ", "ĊĊ", " ĊĊ"]
FLAW_SEPARATOR = "/~/"
SPECIAL_TOKENS = ["<s>", "</s>", "<unk>", "<pad>"]


def normalize_whitespace(code: Column) -> Column:
    """Every run of Unicode white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(code, WHITESPACE, " "))


def word_tokens(text: Column) -> Column:
    """Runs of word characters, and runs of other visible characters."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def code_lines(code: Column) -> Column:
    return F.split(code, "\n")


def count_lines(code: Column) -> Column:
    """Number of lines that are not empty."""
    return F.size(F.filter(code_lines(code), lambda line: F.length(line) > 0))


def parse_flaw_lines(flaws: Column) -> Column:
    """Array of trimmed flaw lines from their joined form; null gives no lines."""
    bare = F.regexp_replace(flaws, r"^[/~]+|[/~]+\z", "")
    lines = F.transform(
        F.split(bare, FLAW_SEPARATOR),
        lambda line: F.regexp_replace(line, rf"^{WHITESPACE}|{WHITESPACE}\z", ""),
    )
    return F.coalesce(lines, F.array().cast("array<string>"))


def strip_token_marks(token: Column) -> Column:
    """Drop the blank mark and read the tab mark as a line mark."""
    return F.replace(
        F.replace(token, F.lit(SPACE_MARK), F.lit("")), F.lit(TAB_MARK), F.lit(LINE_MARK)
    )


def marked_lines(tokens: Column) -> Column:
    """The lines that a token array spells, split at the line mark."""
    return F.split(F.array_join(F.transform(tokens, strip_token_marks), ""), LINE_MARK)


def encode_flaw_line(line: Column) -> Column:
    """Tokens of a flaw line, tokenised behind a leading ``@`` that is dropped again."""
    tokens = word_tokens(F.concat(F.lit("@ "), line))
    kept = F.filter(tokens, lambda token: token != "@")
    return F.transform(kept, lambda t: F.replace(t, F.lit(SPACE_MARK), F.lit("")))


# The words of a prompt.
QUESTION, ANSWER = "Question: ", "\n\nAnswer: "


def make_prompt(code: Column) -> Column:
    return F.concat(F.lit(QUESTION), normalize_whitespace(code), F.lit(ANSWER))


def escape_braces(code: Column) -> Column:
    spaced = F.replace(code, F.lit("{{"), F.lit("{ {"))
    return F.replace(spaced, F.lit("}}"), F.lit("} }"))


def yes_no_label(target: Column, positive_option: str = "YES") -> Column:
    """YES or NO, led by the first character of the option where that is not a Y."""
    prefix = "" if positive_option[0] == "Y" else positive_option[0]
    return F.when(target == 1, prefix + "YES").otherwise(prefix + "NO")


def pick_code_by_label(target: Column, pair: Column) -> Column:
    """Text of the vulnerable side of a pair for label 1, of the patched side otherwise."""
    tokens = F.when(target == 1, pair["vuln"]["tokens"]).otherwise(pair["patch"]["tokens"])
    return F.array_join(tokens, " ")


def run_timestamp(ts: Column, pattern: str = "yyyy-MM-dd_HH-mm-ss") -> Column:
    return F.date_format(ts, pattern)


def run_folder(ts: Column, suffix: str | None = None) -> Column:
    stamp = run_timestamp(ts)
    return F.concat_ws("_", stamp, F.lit(suffix)) if suffix else stamp


def output_name(ts: Column, archive: Column, member: Column) -> Column:
    """``time__archive__member.txt``, both names without folder and extensions."""

    def stem(path: Column, endings: str) -> Column:
        return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), endings, "")

    return F.concat(
        run_timestamp(ts, "yyyy-MM-dd-HH-mm-ss"),
        F.lit("__"),
        stem(archive, r"(\.[^.]+){1,2}$"),
        F.lit("__"),
        stem(member, r"(\.[^.]+){1,2}$"),
        F.lit(".txt"),
    )
