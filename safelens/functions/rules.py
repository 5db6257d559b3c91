"""Deterministic rules over normalised texts."""

from __future__ import annotations

from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTACK, MODERATION = "attack", "moderation"

# The rules' patterns, in their order.
ATTACK_PATTERNS = (
    r"ignore (all |any |the )?(previous|prior|above|earlier) (instruction|prompt|message|rule)",
    r"(reveal|show|print|repeat|display|output) (your |the )?(system|hidden|initial) (prompt|instruction|message)",
    r"(developer|debug|god|sudo|root|unrestricted|jailbreak|dan) mode",
    r"you are (now |going to be )?(dan|an? unrestricted|an? unfiltered|jailbroken)",
    r"<\|?(im_start|im_end|system|assistant|user|endoftext)\|?>",
    r"\[/?INST\]|\[/?SYS\]|<<SYS>>|<</SYS>>",
)
MODERATION_PATTERNS = (
    r"how (to|do i|can i) (make|build|create|construct) (a |an )?(bomb|explosive|weapon)",
    r"(write|create|generate) (a |me )?(virus|malware|ransomware|keylogger)",
    r"(ways|methods|painless way) to (kill myself|commit suicide|end my life)",
    r"(child|minor|underage|preteen).{0,40}(sexual|nude|porn|explicit)",
    r"(write|generate|describe) (a |me |an )?(explicit|graphic|pornographic) (sex|sexual|erotic)",
)
SPACED_LETTERS = r"(?U)(?:\b\w\b[\s._\-]+){5,}\w\b"
HOMOGLYPHS = r"[\x{0400}-\x{04ff}\x{0370}-\x{03ff}]"


#: Characters beyond ASCII that a pattern's letters match when case is ignored.
FOLDED = ("\u0130", "\u0131", "\u017f", "\u212a")


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def _dearest(literals: tuple[str, ...]) -> float:
    """What it costs to look for literals: each is a search, and short ones are found in texts that don't match."""
    return len(literals) + 12 * 0.5 ** (min(map(len, literals)) - 2)


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match of a pattern, case aside, contains one; of several such sets the cheapest. () if there is none.

    A run of letters in a row is a literal of its own; a choice needs a literal from each of its branches; what may be left out gives none.
    """

    def sets(items) -> list[tuple[str, ...]]:
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is _parser.LITERAL:
                run += chr(value).lower()
                continue
            if run:
                found.append((run,))
                run = ""
            if kind is _parser.SUBPATTERN:
                found += sets(value[-1])
            elif kind is _parser.MAX_REPEAT and value[0] >= 1:
                found += sets(value[-1])
            elif kind is _parser.BRANCH:
                each = [sets(branch) for branch in value[1]]
                if all(each):
                    found.append(tuple(dict.fromkeys(x for s in each for x in min(s, key=_dearest))))
        return found

    return min(sets(_parser.parse(pattern)), key=_dearest, default=())


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has a match of any pattern, case aside. A pattern is tried only where one of the literals that it needs stands in the text, or a
    character that folds to one of their letters; searches for literals are many times faster."""
    folded = (F.octet_length(text) != F.length(text)) & _any_in(text, FOLDED)
    out = F.lit(False)
    for p in patterns:
        needed = required_literals(p)
        possible = folded | _any_in(text, needed) if needed else F.lit(True)
        out = out | F.when(possible, text.rlike(any_of((p,)))).otherwise(F.lit(False))
    return out


def _any_in(text: Column, literals: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | text.contains(x)
    return out


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add force_route (sorted), reasons (in order) and allow_fast_skip to normalised rows."""
    attack = F.coalesce(matches(F.col("detection_text"), ATTACK_PATTERNS), F.lit(False))
    moderation = F.coalesce(matches(F.col("detection_text"), MODERATION_PATTERNS), F.lit(False))
    hidden = F.col("flags.excessive_zero_width") | F.col("flags.suspicious_base64") | F.col(text).rlike(SPACED_LETTERS) | F.col(text).rlike(HOMOGLYPHS)
    out = df.withColumns({"__a": attack, "__m": moderation, "__o": F.coalesce(hidden, F.lit(False))})
    route = F.array(F.when(F.col("__a") | F.col("__o"), ATTACK), F.when(F.col("__m"), MODERATION))
    reasons = F.array(F.when(F.col("__a"), "rule:attack"), F.when(F.col("__m"), "rule:moderation"), F.when(F.col("__o"), "rule:obfuscation"))
    out = out.withColumns({"force_route": F.array_compact(route), "reasons": F.array_compact(reasons)})
    return out.withColumn("allow_fast_skip", F.size("force_route") == 0).drop("__a", "__m", "__o")
