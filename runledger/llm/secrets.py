"""Secret scans with DataFrame operations only.

Base patterns find assignments, access keys and long hexadecimal runs. The
entropy scan slides a window over candidate strings of each character class: the
Shannon entropy of a window follows from the counts of its characters, and a
step changes two counts, so the sum behind it is carried along. Windows that are
random enough become spans, unless the candidate is on the allow-list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.rows import bind

# The base patterns in their listed order, and the shortest text that counts.
ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LENGTH = 16
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]

#: Characters of an entropy window.
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one character class: their pattern, what they must hold, bits per character."""

    kind: str
    pattern: str
    needs: tuple[str, ...]
    bits: float


#: A candidate is a whole run of its class. Mixed ones need a digit and letters of both cases.
CLASSES = [
    CharacterClass("entropy_hex", "[0-9A-Fa-f]{20,}", ("[0-9]", "[A-Fa-f]"), 3.0),
    CharacterClass("entropy_mixed", "[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[A-Z]", "[a-z]"), 3.9),
]

#: Candidates that match are no secrets: placeholders and counting sequences.
ALLOWED = [
    "(?i)example|sample|dummy|placeholder|changeme|redacted|your",
    "(?i)0123456789|123456789|abcdefghij|qwerty",
]

#: c * log2(c) in millionths, by c, also for one more than a window holds (a character enters before one leaves).
#: Whole numbers, so that sums carried along stay exact.
_SURPRISE = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 2)]


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of start, end (code points) and the match.

    The texts between matches have one entry more than the matches; running sums
    of their lengths give the places.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def places(found: Column) -> Column:
        steps = F.zip_with(
            found["matches"],
            F.slice(found["between"], F.lit(1), F.size(found["matches"])),
            lambda match, gap: F.struct(match.alias("m"), gap.alias("g")),
        )
        walked = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, step: F.struct(
                (acc["at"] + F.length(step["g"]) + F.length(step["m"])).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + F.length(step["g"])).alias("start"),
                        (acc["at"] + F.length(step["g"]) + F.length(step["m"])).alias("end"),
                        step["m"].alias("match"),
                    ),
                ).alias("out"),
            ),
        )
        return walked["out"]

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.split(text, pattern).alias("between"),
    )
    return F.when(text.rlike(pattern), bind(found, places)).otherwise(none)


def _random_part(match: Column, bits: float) -> Column:
    """First and last window of a candidate that reach ``bits`` per character: (first start, last start), or nulls."""
    # H = log2(W) - S / W with S the sum of c * log2(c) over the window's counts c.
    most = round(WINDOW * (math.log2(WINDOW) - bits) * 1e6)
    table = F.array(*[F.lit(x).cast("long") for x in _SURPRISE])
    characters = bind(
        F.split(match, ""),
        lambda chars: bind(
            F.array_distinct(chars),
            lambda names: F.struct(
                F.transform(chars, lambda c: F.array_position(names, c).cast("int") - 1).alias("codes"),
                F.transform(names, lambda _: F.lit(0)).alias("counts"),
            ),
        ),
    )

    def slide(given: Column) -> Column:
        codes = given["codes"]

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - WINDOW)

            def moved(was: Column) -> Column:
                # The character that enters raises its count, then the one that leaves lowers its own.
                into = F.get(acc["counts"], enters)
                entered = acc["sum"] + F.get(table, into + 1) - F.get(table, into)
                now = F.get(acc["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
                left = F.when(leaves.isNull(), F.lit(0).cast("long")).otherwise(
                    F.get(table, now) - F.get(table, now - 1)
                )
                return entered - left

            start = i - (WINDOW - 1)

            def after(total: Column) -> Column:
                good = (start >= 0) & (total <= most)
                return F.struct(
                    F.transform(
                        acc["counts"],
                        lambda c, k: c
                        + F.when(k == enters, 1).otherwise(0)
                        - F.when(k == leaves, 1).otherwise(0),
                    ).alias("counts"),
                    total.alias("sum"),
                    F.when(acc["first"].isNull() & good, start).otherwise(acc["first"]).alias("first"),
                    F.when(good, start).otherwise(acc["last"]).alias("last"),
                )

            return bind(moved(acc), after)

        start = F.struct(
            given["counts"].alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return bind(characters, slide)


_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.cast("int").alias("end"), F.lit(kind).alias("kind")
    )


def _as_spans(places: Column, kind: str, keep=None) -> Column:
    chosen = F.filter(places, keep) if keep else places
    return F.transform(chosen, lambda x: _span(kind, x["start"], x["end"])).cast(_SPAN)


def _entropy_spans(text: Column, kind: CharacterClass) -> Column:
    def is_candidate(x: Column) -> Column:
        ok = F.lit(True)
        for need in kind.needs:
            ok = ok & x["match"].rlike(need)
        for allowed in ALLOWED:
            ok = ok & ~x["match"].rlike(allowed)
        return ok

    def part(x: Column) -> Column:
        return bind(
            _random_part(x["match"], kind.bits),
            lambda p: F.when(p["first"].isNotNull(), _span(kind.kind, x["start"] + p["first"], x["start"] + p["last"] + WINDOW)),
        )

    found = F.transform(F.filter(located(text, kind.pattern), is_candidate), part)
    return F.filter(found, lambda x: x.isNotNull()).cast(_SPAN)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base_spans, spans``: arrays of spans by start, then kind as in :data:`KINDS`.

    Starts count code points from 0, ends are exclusive. Null and empty texts
    have no spans. Rows are independent, so null ids, repeated rows and further
    columns have no effect; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(
        _as_spans(
            located(text, ASSIGN),
            "assign",
            lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_VALUE,
        ),
        _as_spans(located(text, ACCESS), "access", lambda x: x["end"] - x["start"] >= ACCESS_LENGTH),
        _as_spans(located(text, HEX), "hex"),
    )
    random = F.concat(*[_entropy_spans(text, kind) for kind in CLASSES])
    return docs.select(
        "doc_id", F.sort_array(base).alias("base_spans"), random.alias("random")
    ).select("doc_id", "base_spans", F.sort_array(F.concat("base_spans", "random")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
        ),
        ",",
    )


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`scan_secrets` returned."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
