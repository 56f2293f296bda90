"""From raw fragment to note; and one line's way through the transcript cleaner."""

from __future__ import annotations

from memloom.functions import predicates as P
from memloom.functions import redact as X
from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.functions.dialect import planned


def cut_chrome(d, t, patterns):
    """Cut chrome to the end of its line."""
    t = d.replaces(t, [(p, "") for p in patterns], icase=True, lines=True)
    t = d.replace(t, r"[ \t]{2,}", " ")
    return d.replace(t, r"^[ \t]+|[ \t]+$", "", lines=True)


@planned
def scrub_document(d, t):
    """What is done to a transcript before it is split into lines."""
    t = cut_chrome(d, cut_chrome(d, T.strip_controls(d, t), R.CUT_A), R.CUT_B)
    return X.redact(d, X.auth_urls_off(d, t))


def clean_fragment(d, t):
    """A fragment of one line through the whole cleaner: blank if it is noise."""

    def judge(line):
        noise = P.noisy_line(d, line) | P.envelope_start(d, line) | P.spec_heading(d, line)
        return d.when((noise, ""), otherwise=X.redact(d, X.auth_residue_off(d, line)))

    return d.let(T.normal_line(d, scrub_document(d, t)), judge)


def _lead_ins_off(d, t):
    for pattern, group in R.LEAD_INS:
        t = d.replace(t, pattern, f"\\{group}" if group else "", icase=True)
    return d.trim(t)


@planned
def repair(d, raw):
    """A clean, capitalised, closed note; blank if nothing is left."""

    def note(t):
        t = d.replace(T.label_off(d, t), r"^[-*+•]\s+", "")
        t = d.trim(d.replace(d.replace(t, "^[\"'`]+", ""), "[\"'`]+$", ""))
        t = d.replaces(t, R.CONTRACTIONS.items(), icase=True)
        t = d.trim(d.replace(t, r"\s*[.!?]+$", ""))
        t = d.repeat_fold(t, 8, lambda x: _lead_ins_off(d, x))
        t = d.replace(t, r"[\s,;]*[⠀-⣿]+\s*working\b(?:\s+\d+\s*k?\s*tokens?)?[.\s]*$", "", icase=True)
        t = d.trim(d.replace(d.trim(t), r"\bworking\s+\d+\s*k?\s*tokens?\b[.\s]*$", "", icase=True))
        t = d.trim(d.replace(t, r",?\s*auto\s*·\s*\d+(?:\.\d+)?%\s*auto-?run\b[.\s]*$", "", icase=True))
        return d.let(t, closed)

    def closed(t):
        capital = d.concat(d.upper(d.slice(t, 1, 1)), d.slice(t, 2))
        start = d.when((T.token_is_code(d, T.first_word(d, t)), t), otherwise=capital)
        stop = d.when((d.matches(t, r"[.!?]$") | T.token_is_code(d, T.last_word(d, t)), ""), otherwise=".")
        return d.when((t == "", ""), otherwise=d.concat(start, stop))

    def start(t):
        return d.when(((t == "") | P.ui_line(d, t), ""), otherwise=note(t))

    cleaned = d.trim(d.replace(clean_fragment(d, raw), r"\s+", " "))
    return d.let(cut_chrome(d, cleaned, R.CUT_A + R.CUT_B + R.CUT_C), start)
