"""What a line, sentence or candidate is: chrome, code, pasted instructions, bug, resolution, quality.

Each rule reads `t` several times; callers bind it first (a column, or d.let).
"""

from __future__ import annotations

from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.functions.dialect import planned

# lines ------------------------------------------------------------------------------


def ui_line(d, t):
    def judge(u):
        return (u == "") | d.matches(u, R.UI_LINES) | d.matches(u, R.UI_LINES_EXACT, icase=False)

    u = d.replace(d.replace(T.normal_line(d, t), r"^[-*+•]\s*", ""), r"^›\s*", "")
    return d.let(d.trim(u), judge)


def high_symbol_noise(d, t):
    """More than 45 % of at least 24 characters are symbols."""

    def judge(dense):
        letters = d.length(d.replace(dense, r"[^A-Za-z0-9]+", ""))
        return (d.length(dense) >= 24) & ((d.length(dense) - letters) * 100 > d.length(dense) * 45)

    return d.let(d.replace(t, r"\s+", ""), judge)


def _blob(d, t, words, noisy):
    def judge(c):
        return d.matches(c, words, icase=False) | (d.matches(c, noisy, icase=False) & high_symbol_noise(d, t))

    return d.let(T.compact(d, t), judge)


def intro_a(d, t):
    return _blob(d, t, R.AGENT_A_INTRO, R.NOISY_A)


def intro_b(d, t):
    return _blob(d, t, R.AGENT_B_INTRO + R.AGENT_B_AUTH, R.NOISY_B)


def intro_c(d, t):
    return _blob(d, t, R.AGENT_C_INTRO, R.NOISY_C)


def auth_noise(d, t):
    """Sign-in screens of any agent."""
    return d.matches(T.compact(d, t), R.AGENT_A_AUTH + R.AGENT_B_AUTH + R.AGENT_C_AUTH, icase=False)


def code_statement(d, t):
    return d.matches(t, R.CODE_STATEMENTS, icase=False)


def punctuation_heavy(d, t):
    brackets, semis = d.count(t, r"[(){}\[\]]"), d.count(t, ";")
    dense = (brackets + semis >= 5) | (semis >= 2) | d.matches(t, [r"^\s*[{(\[]", *R.CALLS], icase=False)
    return (brackets + semis > 0) & (dense | ((brackets > 0) & d.matches(t, R.CODE_WORDS, icase=False)))


def diff_or_code(d, t):
    def judge(u):
        body = d.trim(d.replace(u, r"^[+-]\s+", ""))
        glued = d.count(u, r"(?:^|[\s;,)])\d+\s*[+-]\s") >= 2
        marker = d.matches(u, r"(?:^|[\s;,)('\"])\d{2,}\s*[+-]", icase=False) & d.matches(u, r"[(){}\[\];]", icase=False)
        shaped = d.let(body, lambda b: code_statement(d, b) | punctuation_heavy(d, b))
        return (u != "") & (d.matches(u, R.DIFF_LINES, icase=False) | glued | marker | (d.count(u, "[•·]") >= 4) | shaped)

    return d.let(d.trim(t), judge)


def _listed(d, t, judge):
    """A rule on the text without its list prefix; blank texts never fit."""
    return d.let(T.list_prefix_off(d, t), lambda u: (u != "") & judge(u))


def session_status(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.SESSION_STATUS))


def own_output(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.OWN_OUTPUT) & ~d.matches(u, R.OWN_OUTPUT_EXEMPT))


def spec_directive(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.SPEC_DIRECTIVES))


def prompt_request(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.PROMPT_REQUESTS))


def task_chrome_a(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.TASK_CHROME_A))


def task_chrome_b(d, t):
    def judge(u):
        exempt = d.matches(u, r"^bug:\s+") | (d.matches(u, r"^todo:\s+") & d.matches(u, rf"\b{R.TOOL}\b"))
        return ~exempt & (d.matches(u, R.TASK_CHROME_B) | intro_b(d, u))

    return _listed(d, t, judge)


def task_chrome_c(d, t):
    return _listed(d, t, lambda u: ~d.matches(u, r"^bug:\s+") & (d.matches(u, R.TASK_CHROME_C) | intro_c(d, u)))


def runtime_status(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.RUNTIME_STATUS))


def template_placeholder(d, t):
    return d.matches(d.trim(t), R.PLACEHOLDERS, icase=False)


def review_summary(d, t):
    def judge(u):
        concrete = d.matches(u, R.REVIEW_EXEMPT[0]) & d.matches(u, R.REVIEW_EXEMPT[1])
        issue = d.matches(u, R.QUALITY_ISSUE) & ~d.matches(u, R.QUALITY_ISSUE_FACT)
        return ~d.matches(u, r"^bug:\s+") & ~concrete & (d.matches(u, R.REVIEW_SUMMARY) | issue)

    return _listed(d, t, judge)


def narration(d, t):
    return d.matches(T.plain(d, t), R.NARRATION)


def slash_help(d, t):
    return d.matches(d.trim(t), r"^/[a-z0-9][a-z0-9-]*(?:\s|$)", icase=False) | d.matches(t, R.SLASH_HELP)


# blocks -----------------------------------------------------------------------------


@planned
def spec_heading(d, t):
    return _listed(d, t, lambda u: d.matches(u, R.SPEC_HEADINGS))


def envelope_start(d, t):
    return d.matches(T.list_prefix_off(d, t), R.ENVELOPE_START)


def envelope_end(d, t):
    return d.matches(d.trim(t), R.ENVELOPE_END)


def bullet(d, t):
    return d.matches(d.trim(t), r"^[-*+•]\s+")


def numbered_or_blank(d, t):
    return d.matches(d.trim(t), r"^(?:\d+[.)]\s+|$)")


def block_tail(d, t):
    return d.matches(d.trim(t), r"^[a-z0-9`.-]", icase=False)


def may_go_on(d, t):
    """Whether the line after this one can be part of it."""
    return (t != "") & ~(d.matches(t, "^```") | d.matches(t, r"[.!?]$"))


def must_go_on(d, t):
    return d.matches(t, r"[,;:]$")


def may_join(d, t):
    """Whether this line can be part of the line before it."""
    return (t != "") & ~d.matches(t, ["^```", *R.WRAP_BLOCK], icase=False)


def must_join(d, t):
    return d.matches(t, R.WRAP_JOIN)


@planned
def joins_previous(d, before, t):
    """Whether a line goes on where the line before it stopped."""
    apart = d.matches(before, "^```") | d.matches(t, ["^```", *R.WRAP_BLOCK], icase=False) | d.matches(before, r"[.!?]$")
    return (before != "") & (t != "") & ~apart & (d.matches(before, r"[,;:]$") | d.matches(t, R.WRAP_JOIN))


# composites -------------------------------------------------------------------------

LINE_RULES = {
    "ui_line": ui_line, "intro_a": intro_a, "intro_b": intro_b, "intro_c": intro_c, "diff_or_code": diff_or_code,
    "own_output": own_output, "spec_directive": spec_directive, "prompt_request": prompt_request, "task_chrome_a": task_chrome_a,
    "task_chrome_b": task_chrome_b, "session_status": session_status, "template_placeholder": template_placeholder,
    "runtime_status": runtime_status,
}
SENTENCE_RULES = {
    "narration": narration, "auth_noise": auth_noise, "diff_or_code": diff_or_code, "own_output": own_output,
    "spec_directive": spec_directive, "prompt_request": prompt_request, "task_chrome_a": task_chrome_a,
    "task_chrome_b": task_chrome_b, "task_chrome_c": task_chrome_c, "review_summary": review_summary,
    "session_status": session_status, "runtime_status": runtime_status,
}


def any_rule(d, t, table):
    out = None
    for rule in table.values():
        out = rule(d, t) if out is None else out | rule(d, t)
    return out


@planned
def noisy_line(d, t):
    return any_rule(d, t, LINE_RULES)


@planned
def noisy_sentence(d, t):
    return any_rule(d, t, SENTENCE_RULES)


# memories ---------------------------------------------------------------------------


def resolution(d, t):
    """Of lower-cased text."""
    return d.matches(t, R.RESOLUTION, icase=False)


def concrete_bug(d, t):
    """Of lower-cased text."""
    veto = review_summary(d, t) | task_chrome_a(d, t) | task_chrome_b(d, t) | d.matches(t, R.BUG_VETOES, icase=False)
    veto = veto | d.matches(T.compact(d, t), R.BUG_VETOES_COMPACT, icase=False)
    of_tool = d.matches(t, R.BUG_OF_TOOL[0], icase=False) & d.matches(t, R.BUG_OF_TOOL[1], icase=False)
    return ~veto & (d.matches(t, R.BUGS, icase=False) | of_tool)


@planned
def classify(d, sentence):
    """One of the categories, or null."""

    def judge(p):
        def route(t):
            veto = prompt_request(d, p) | task_chrome_a(d, p) | task_chrome_b(d, p) | task_chrome_c(d, p) | review_summary(d, p)
            veto = veto | d.matches(T.compact(d, p), R.AGENT_B_AUTH + R.AGENT_C_AUTH, icase=False)
            return d.when(
                (resolution(d, t), "resolved"), (veto, None),
                (d.matches(t, R.ERRORS, icase=False) | d.matches(p, R.STACK_FRAME, icase=False), "errors"), (concrete_bug(d, t), "bugs"),
                (d.matches(t, R.DECISIONS, icase=False), "decisions"), (d.matches(t, R.TODOS, icase=False), "todos"), otherwise=None,
            )

        return d.let(d.lower(p), route)

    return d.let(T.plain(d, sentence), judge)


def reject_reasons(d, text, category) -> dict:
    """Reason -> whether it rejects a repaired memory (`text` bound, `category` an expression)."""
    core = d.trim(d.replace(d.replace(d.trim(text), r"^[-*+•]\s+", ""), r"[.!?]+$", ""))
    return {"core": core, "rules": _reasons(d, category)}


def _reasons(d, category):
    def short(c):
        return ~(category == "errors") & ~T.command_like(d, c) & (T.meaningful_words(d, c) < 3)

    def lower_start(c):
        return d.matches(c, r"^[a-z]", icase=False) & ~T.command_like(d, c) & ~T.token_is_code(d, T.first_word(d, c))

    return {
        "blank": lambda c: c == "", "chrome": lambda c: ui_line(d, c) | noisy_sentence(d, c),
        "vague_bug": lambda c: (category == "bugs") & ~d.let(d.lower(c), lambda x: concrete_bug(d, x)),
        "forbidden_start": lambda c: d.matches(c, R.FORBIDDEN_START), "dependent_clause": lambda c: d.matches(c, R.DEPENDENT_START),
        "slash_help": lambda c: slash_help(d, c), "lower_start": lower_start, "too_few_words": short,
    }


@planned
def reasons_text(d, text, category):
    """Comma-separated reasons against a memory; empty: it is good."""
    found = reject_reasons(d, text, category)

    def judge(c):
        parts = [d.when((rule(c), name + ","), otherwise="") for name, rule in found["rules"].items()]
        return d.concat(*parts)

    return d.let(found["core"], judge)


@planned
def quality(d, text, category):
    found = reject_reasons(d, text, category)

    def judge(c):
        out = None
        for rule in found["rules"].values():
            out = rule(c) if out is None else out | rule(c)
        return ~out

    return d.let(found["core"], judge)


@planned
def suspicious(d, text, category):
    """A survivor that still smells of echo or chrome."""

    def judge(c):
        chrome = prompt_request(d, c) | task_chrome_a(d, c) | task_chrome_b(d, c) | task_chrome_c(d, c) | review_summary(d, c)
        chrome = chrome | runtime_status(d, c) | slash_help(d, c) | d.matches(c, R.SUSPICIOUS)
        chrome = chrome | d.matches(T.compact(d, c), R.AGENT_B_AUTH, icase=False)
        words = T.meaningful_words(d, c)
        vague = (category == "bugs") & ~d.let(d.lower(c), lambda x: concrete_bug(d, x))
        thin = (category == "summaries") & d.matches(c, r"^this session captured\b") & (words < 6)
        return (c == "") | chrome | vague | thin | (~(category == "errors") & (words < 3))

    return d.let(d.trim(text), judge)
