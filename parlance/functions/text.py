"""Text rules as column expressions: all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules for transcript lines (pattern, replacement), applied in this order. (?U): Unicode classes.
SPOKEN_MARKS = [
    ("<comma>", ","),
    ("<period>", "."),
    ("<questionmark>", "?"),
    ("<exclamationpoint>", "!"),
    ("<sil>", "[sil]"),
    ("<music>", "[music]"),
    ("<noise>", "[noise]"),
    ("<other>", "[other]"),
    (r" \[!\]", "!"),
]
BRACKETED = [(r"\[[^%\]].*?\]", "")]
NOTATION = [
    (r"\x15[0-9]+?_[0-9]+?\x15", ""),
    (r'\+[",]', ""),
    (r"\+/\.", ""),
    ("&-", ""),
    ("[°☺⁎]", " "),
    (r"(?U)[^\w !?.,;\"'`()&=%\-\[\]]", ""),
    ("ʔ", ""),
    (r"(?U)&[l,n]=.+?(?=(?:\s|\z))", ""),
    (r"(?iU)&=(?:lengthened|tsk|in|nonvocal|ex)(?=(?:\s|\z))", ""),
    (r"\(\( *(.*?) *\)\)", "$1"),
    (r"(?U)(?<=[ _]\w)\.?_", "."),
    (r"(?U)(?<=\A\w)\.?_", "."),
    ("_", " "),
    (" {2,}", " "),
    (" (?=[!?.,;'])", ""),
    (" (?=n')", ""),
]
# Tags that recognisers write, and what they become.
ASR_LITERALS = [("[ ", "["), (" ]", "]"), ("[blank_audio]", ""), ("[inaudible]", ""), ("[silence]", ""), ("[pause]", ""), ("mm-hmm", "mhm"), ("...", ""), (",", ""), (".", ""), (">>", "")]
# Marks that are not to be spoken, and what becomes of them.
TTS_RULES = [
    (r"\([0-9]*?\.[0-9]*?\)", "..."),
    (r"(?iU)(?:\s|\A)i?[hx]+[.,?!]*(?=(?:\s|\z))", ""),
    (r"0 ?(?=\[)", ""),
    (r"0[.]", ""),
    (r"\[.*?\]", ""),
    (r"(?U)&=.*?(?=(?:\s|\z))", ""),
    (r"(?U)\s+", " "),
]
# Words of sounds that a generated text may be kept from.
NOISE_WORDS, BREATH_WORDS, LAUGH_WORDS = ("noise", "wind", "blow", "mn"), ("breath", "hh", "cough"), ("laugh",)
EXTERNAL_MARKER = "†"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, F.lit(rule[0]), F.lit(rule[1])), rules, c)


#: Every rule but PLAIN needs one of these characters in the line.
MARKED = r"[<\[\x15+&°☺⁎ʔ(_]"
PLAIN = [NOTATION[5], NOTATION[13], NOTATION[14], NOTATION[15]]


def clean_line(c: Column, remove_bracketed: bool = False) -> Column:
    """A transcript line without annotation marks; remove_bracketed drops [...] that isn't a comment or a sound.

    Most lines have no marks at all and take the few rules that can still change them.
    """
    every = _rules(c, [*SPOKEN_MARKS, *(BRACKETED if remove_bracketed else []), *NOTATION])
    return strip(F.when(c.rlike(MARKED), every).otherwise(_rules(c, PLAIN)))


def nonempty(text: Column) -> Column:
    """explode() of a text unless it is empty: drops rows like a filter, but makes the text only once."""
    return F.explode(F.filter(F.array(text), lambda t: F.length(t) > 0))


def clean_asr_text(c: Column) -> Column:
    """Recognised speech in lower case without tags and full stops."""
    return strip(reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), ASR_LITERALS, F.lower(c)))


def sanitize_for_tts(c: Column) -> Column:
    """A line that a speech synthesiser can read: pauses as dots, no breaths, events or brackets."""
    return strip(_rules(c, TTS_RULES))


def allowed_text_flag(c: Column, noise: bool = False, breathing: bool = False, laughter: bool = False) -> Column:
    """Whether a text has none of the words of the kinds that aren't allowed."""
    barred = [*(() if noise else NOISE_WORDS), *(() if breathing else BREATH_WORDS), *(() if laughter else LAUGH_WORDS)]
    return ~reduce(lambda x, w: x | F.contains(F.lower(c), F.lit(w)), barred, F.lit(False))


def last_token_in(c: Column, wordlist: list[str]) -> Column:
    """Whether the last word is in a list of backchannels."""
    return F.element_at(F.split(strip(c), r"(?U)\s+"), -1).isin(wordlist)


def words(c: Column) -> Column:
    """The words between white space."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def count_speakers_in_text(c: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Z]): "), F.lit(1))))


def strip_non_audio(c: Column) -> Column:
    """Only the characters that stand for audio codes (from U+E000)."""
    return F.regexp_replace(c, "[^\\x{E000}-\\x{10FFFF}]", "")


def shorten_codes(c: Column) -> Column:
    """Runs of more than eight code characters as four, dots, and four."""
    code = "[\\x{E000}-\\x{10FFFF}]"
    return F.regexp_replace(c, f"({code}{{4}}){code}+({code}{{4}})", "$1.........$2")


def turns_of_sequence(c: Column) -> Column:
    """array<struct<speaker, text, text_with_external_markers>> of the turns "X: ..." of a text."""
    pattern = F.lit(r"([A-Z]):(.*?)(?= [A-Z]:|\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("t"))
    left = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    return F.transform(pairs, lambda p: F.struct(p["s"].alias("speaker"), left(F.replace(left(p["t"]), F.lit(EXTERNAL_MARKER), F.lit(""))).alias("text"), left(p["t"]).alias("text_with_external_markers")))


def sentence_text(c: Column) -> Column:
    """The pieces of a sentence, joined: on one line, brackets closed up, trimmed."""
    return strip(F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("[ "), F.lit("[")), F.lit(" ]"), F.lit("]")))


def format_timestamp(secs: Column) -> Column:
    """H:MM:SS.mmm from seconds, by whole milliseconds."""
    ms = F.round(secs * 1000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    div = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    return F.concat(div(ms, 3600000).cast("string"), F.lit(":"), two(div(ms, 60000) % 60), F.lit(":"), two(div(ms, 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def two_decimals(centisecs: Column) -> Column:
    """Text with two decimals of a whole number of hundredths, so that no binary rounding takes part."""
    c = centisecs.cast("bigint")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(F.abs(c) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))
