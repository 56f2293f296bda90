"""Secrets and sign-in residue: detection and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import rules as R
from memloom.functions.dialect import java, planned


def auth_urls_off(d, t):
    marks = "|".join(m.replace(".", r"\.") for m in R.AUTH_URL_MARKS)
    # with a mark anywhere in it, the whole run goes
    return d.replace(t, rf"https?://\S*(?:{marks})\S*", "", icase=True)


def auth_residue_off(d, t):
    return d.replace(d.replace(t, R.AUTH_RESIDUE, "", icase=True), R.AUTH_STATE, "", icase=True)


#: SQL cannot look ahead: there, the names that bear a secret are told one by one.
_UP = R.SECRET_WORD
_NAMES = (
    rf"(?:[A-Z][A-Z0-9_]*?)?(?:{_UP})[A-Z0-9_]*|[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]*?(?i:{_UP})[A-Za-z0-9_]*|"
    rf"[A-Za-z][A-Za-z0-9]*?(?i:{_UP})[A-Za-z0-9]*_[A-Za-z0-9_]*|(?i:{_UP})[A-Za-z0-9]*_[A-Za-z0-9_]*|"
    r"(?i:[a-z0-9]*(?:api_key|access_key|secret_key|private_key|service_role_?key|service_?role_key|encryption_key|signing_key|"
    r"session_key|database_url|redis_url)[a-z0-9_]*)"
)
_LEAD = r"(^|[^A-Za-z0-9_.$])"
#: An assignment to any name first; then the name has an underscore or is in capitals, and has a secret word in it.
_ASSIGN = (
    r"(?<![A-Za-z0-9_.$])(?=[A-Za-z])(?=[A-Za-z0-9_]++\s*+[:=])(?=[A-Za-z0-9]*_|[A-Z0-9]+(?![A-Za-z0-9_]))"
    rf"(?=[A-Za-z0-9_]*?(?i:{_UP}))([A-Za-z0-9_]+)(\s*[:=]\s*)"
)
#: Of a value: a quoted string and what is glued to it, or a run without the punctuation at its end; punctuation alone stays.
_VALUE = rf"(?:(?:{R.ASSIGN_VALUE})(?:\S*[^\s.,;:!?])?|\S*[^\s.,;:!?]|([.,;:!?]+))"


def _assignments_off(d, t):
    mark = R.PLACEHOLDER
    if hasattr(d, "looks_ahead"):
        # possessive groups run in a loop; others would need a stack as deep as the string is long
        return d.looks_ahead(t, _ASSIGN + _VALUE.replace(")*", ")*+"), rf"$1$2{mark}$3", SECRET_LITERALS)
    return d.replace(t, rf"{_LEAD}({_NAMES})(\s*[:=]\s*){_VALUE}", rf"\1\2\3{mark}\4")


@planned
def redact(d, t):
    """Secret values become the placeholder; names, separators and closing punctuation stay.

    Of `Label: NAME=value` the inner assignment is redacted too. Redacting twice changes nothing.
    """
    mark = R.PLACEHOLDER
    t = d.replaces(t, [(R.PEM_BLOCK, mark), (R.PEM_MARK, mark), (R.CREDENTIAL_URL, mark)])
    t = _assignments_off(d, t)
    # one by one where a literal is common, so that it does not call for the others
    t = d.replaces(t, [(p, mark) for k, p in R.TOKENS.items() if k != "github-token"])
    t = d.replaces(t, [(R.TOKENS["github-token"], mark)])
    return d.replaces(d.replaces(t, [(R.OAUTH_PARAM, rf"\1={mark}")]), [(R.OAUTH_STATE, rf"\1={mark}")])


#: One of these, in lower case, is in every name that bears a secret.
SECRET_LITERALS = ["key", "token", "secret", "passw", "passphrase", "credential", "database", "redis"]
#: kind -> pattern of what is found, for counts
FINDINGS = {
    "private-key": rf"{R.PEM_BLOCK}", "credentialed-url": R.CREDENTIAL_URL, **R.TOKENS, "oauth-param": R.OAUTH_PARAM,
    "oauth-state": R.OAUTH_STATE, "env-assignment": rf"{_LEAD}({_NAMES})(\s*[:=]\s*)(?:{R.ASSIGN_VALUE}|[^\s\"'`\[]\S*)",
}


def findings(d, t, kind: str):
    """How many secrets of a kind the text has."""
    return d.count(t, FINDINGS[kind])


def detect(t):
    """Array of (kind, match, index) of all secrets of a text, by kind, then place; index counts from 0.

    A lone key mark counts only where no key block is. What is redacted already is none.
    """
    name = rf"{_ASSIGN}(?:{R.ASSIGN_VALUE}|\S+)".replace(")*", ")*+")
    blocks = {"private-key": R.PEM_BLOCK, "key-mark": R.PEM_MARK}
    kinds = {**blocks, "credentialed-url": R.CREDENTIAL_URL, **R.TOKENS, "oauth-param": R.OAUTH_PARAM, "oauth-state": R.OAUTH_STATE}
    found = {k: _found(t, java(p), k) for k, p in kinds.items()} | {"env-assignment": _found(t, name, "env-assignment")}
    found["env-assignment"] = F.filter(found["env-assignment"], lambda x: ~F.contains(x["match"], F.lit(R.PLACEHOLDER)))
    mark = found.pop("key-mark")
    marks = F.transform(mark, lambda x: F.struct(F.lit("private-key").alias("kind"), x["match"].alias("match"), x["index"].alias("index")))
    block = found.pop("private-key")
    return F.flatten(F.array(F.when(F.size(block) > 0, block).otherwise(marks), *found.values()))


def _found(t, pattern: str, kind: str):
    matches, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)

    def place(m, at):  # after all that stands between and all matches before
        upto = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda sum_, x: sum_ + F.length(x))
        index = upto(between, at + 1) + upto(matches, at)
        return F.struct(F.lit(kind).alias("kind"), m.alias("match"), index.alias("index"))

    return F.transform(matches, place)


@planned
def redaction_only(d, t):
    mark = R.PLACEHOLDER.replace("[", r"\[").replace("]", r"\]")
    rest = d.replace(d.replace(t, rf"[A-Za-z][A-Za-z0-9_]*\s*[:=]\s*{mark}", " "), mark, " ")
    rest = d.replace(rest, r"-----(?:BEGIN|END)[^-]*-----", " ")
    return d.contains(t, R.PLACEHOLDER) & ~d.matches(rest, r"[A-Za-z]{2}")
