"""Scalar text functions: normal forms, control sequences, lines, code tokens, word counts."""

from __future__ import annotations

from memloom.functions import rules as R
from memloom.functions.dialect import WIDE_SPACES


def normal_form(d, t):
    """What duplicates have in common."""
    t = d.replace(d.trim(d.lower(t)), rf"[\s{WIDE_SPACES}]+", " ")
    t = d.replace(t, r"[!?.]*([!?.])([!?.])", r"\2")
    t = d.replace(t, r"^[-*]\s+", "")
    t = d.replace(t, "['\"«»„“”]", "'")
    return d.trim(d.replace(t, r"[.!?]+$", ""))


def compact(d, t):
    """Lower-case letters and digits only: finds words in blobs that lost their spaces."""
    return d.replace(d.lower(t), r"[^a-z0-9]+", "")


def strip_controls(d, t):
    """Terminal control sequences go; carriage returns end lines; tabs are blanks."""
    esc = "\\x1B"
    t = d.replaces(t, [
        (rf"{esc}\](?s:.*?)(?:\x07|{esc}\\)", ""), (rf"{esc}[P_^X](?s:.*?)(?:\x07|{esc}\\)", ""), (rf"{esc}\[[0-?]*[ -/]*[@-~]", ""),
        (rf"{esc}[()#%*+\-./][0-~]", ""), (rf"{esc}[@-Z\\-_]", ""),
    ])
    t = d.replaces(t, [(r"(?i:(?:\d{1,2};)?rgb:[0-9a-f]{1,4}/[0-9a-f]{1,4}/[0-9a-f]{1,4})", ""), (r"\]\d{1,2};\?", "")])
    t = d.replace(d.replace(t, r"\r", "\n"), r"\t", " ")
    return d.replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")


def normal_line(d, t):
    """Box drawing becomes blanks; blanks become one."""
    t = d.replace(t, f"[{R.BOX_GLYPHS}│║▄▀█{WIDE_SPACES}]+|[─━═]{{3,}}", " ")
    return d.trim(d.replace(t, r"\s+", " "))


def list_prefix_off(d, t):
    t = d.replace(d.trim(t), r"^[-*+•]\s+", "")
    return d.trim(d.replace(d.replace(t, r"^›\s*", ""), r"^\$\s+", ""))


def plain(d, t):
    return d.trim(d.replace(normal_line(d, strip_controls(d, t)), r"^[-*+•]\s*", ""))


def label_off(d, t):
    """A leading transcript label goes, and only then are the ends trimmed."""
    return d.when((d.matches(t, R.METADATA_LABEL), d.trim(d.replace(t, R.METADATA_LABEL, "", icase=True))), otherwise=t)


def metadata_off(d, t):
    """A line of transcript metadata: its content, or blank where that is a bare value."""

    def rest(r):
        bare = (r == "") | d.matches(r, R.METADATA_VALUES)
        return d.when((r == t, t), (bare, ""), otherwise=r)

    return d.let(label_off(d, t), rest)


def token_is_code(d, t):
    return (
        d.matches(t, [r"^[`$]", r":\d+", r"^[A-Z][A-Z0-9_]{2,}$"], icase=False)
        | (d.matches(t, r"[/\\]") & d.matches(t, r"\w"))
        | (d.matches(t, r"\w\.\w{1,5}$") & d.matches(t, r"\.[a-z]{1,5}$"))
        | d.isin(d.lower(t), R.COMMANDS)
    )


def command_like(d, t):
    first = d.lower(d.extract(t, r"^\S+"))
    return d.matches(t, [r"^[`$]", r"[/\\][\w.\-/\\]+", r"\.\w{1,5}:\d+"]) | d.isin(first, R.COMMANDS)


def meaningful_words(d, t):
    words = d.split(d.replace(d.lower(t), r"[^a-z0-9\s]", " "), r"\s+")
    return d.size(d.words_kept(words, lambda w: (d.length(w) >= 2) & ~d.isin(w, R.STOP_WORDS)))


def first_word(d, t):
    return d.extract(t, r"^\S+")


def last_word(d, t):
    return d.extract(t, r"\S+$")


def match_token(d, w):
    """Canonical form of a word for resolution matching."""
    return d.when(
        (d.matches(w, r"^truncat", icase=False), "truncat"), (d.matches(w, r"^fenc", icase=False), "fence"),
        (d.matches(w, r"^doc", icase=False), "document"), otherwise=d.replace(w, r"(?:ing|ed|s)$", ""),
    )



def truncated(d, t, n: int):
    """The first n characters without white space at their end, or the text if it is no longer."""
    return d.when((d.length(t) > n, d.replace(d.slice(t, 1, n), r"\s+$", "")), otherwise=t)


def short(d, t, n: int = 92):
    """One line of at most n characters; a cut one ends in three dots."""

    def cut(u):
        return d.when((d.length(u) > n, d.concat(d.replace(d.slice(u, 1, n - 3), r"\s+$", ""), "...")), otherwise=u)

    return d.let(d.trim(d.replace(t, rf"[\s{WIDE_SPACES}]+", " ")), cut)


def padded(d, t, width: int):
    """Blanks up to a width; longer texts stay whole."""
    return d.when((d.length(t) < width, d.pad(t, width)), otherwise=t)
