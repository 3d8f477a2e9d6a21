"""Row validators as boolean columns: exact key sets, enumerations, ranges, lengths, patterns; and checks of documents against their source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: The form of a posting's key and of a hash.
JOB_KEY, HASH = r"^[a-z_]{2,40}:[^\s]{1,200}$", r"^[0-9a-f]{64}$"


def keys_are(row: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """Whether a map has all required keys and no others but the optional ones."""
    return F.coalesce(F.forall(F.map_keys(row), lambda k: k.isin([*required, *(optional or [])])) & (F.size(F.array_intersect(F.map_keys(row), F.array(*[F.lit(r) for r in required]))) == len(required)), F.lit(False))


def is_day(value: Column) -> Column:
    """Null, or a real date written YYYY-MM-DD."""
    return value.isNull() | (value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).isNotNull())


def is_https(value: Column, most: int = 2000) -> Column:
    return value.isNull() | ((F.length(value) <= most) & value.rlike(r"(?i)^https://[^/?#\s]+"))


def is_instant(value: Column) -> Column:
    return F.coalesce(F.length(value).between(10, 40), F.lit(False))


def is_count(value: Column, low: int = 0, high: int | None = None) -> Column:
    number = F.when(value.rlike(r"^-?\d{1,18}$"), value.cast("bigint"))
    return F.coalesce((number >= low) & (F.lit(True) if high is None else number <= high), F.lit(False))


def is_reasons(value: Column, most: int = 3, longest: int = 160) -> Column:
    """A JSON list of at most most strings of 1 to longest characters."""
    items = F.from_json(value, "array<string>")
    return F.coalesce(value.rlike(r"^\s*\[") & (F.size(items) <= most) & F.forall(items, lambda x: F.length(x).between(1, longest)), F.lit(False))


def application(row: Column, statuses: list[str]) -> Column:
    """Whether a map of strings is a well-formed application."""
    fields = ["job_key", "status", "applied_at", "follow_up_at", "note", "cv_url", "updated_at"]
    got = lambda c: F.try_element_at(row, F.lit(c))
    note = got("note").isNull() | (F.length(got("note")) <= 2000)
    again = got("reactivated_at").isNull() | is_instant(got("reactivated_at"))
    return F.coalesce(keys_are(row, fields, ["reactivated_at"]) & got("job_key").rlike(JOB_KEY) & got("status").isin(statuses) & is_day(got("applied_at")) & is_day(got("follow_up_at")) & note & is_https(got("cv_url")) & is_instant(got("updated_at")) & again, F.lit(False))


def decision(row: Column, labels: list[str]) -> Column:
    got = lambda c: F.try_element_at(row, F.lit(c))
    score = got("score_at_decision").isNull() | is_count(got("score_at_decision"), 0, 100)
    return F.coalesce(keys_are(row, ["id", "job_key", "label", "score_at_decision", "created_at"]) & is_count(got("id")) & got("job_key").rlike(JOB_KEY) & got("label").isin(labels) & score & is_instant(got("created_at")), F.lit(False))


def verdict(row: Column, levels: list[str]) -> Column:
    got = lambda c: F.try_element_at(row, F.lit(c))
    fields = ["score", "level", "reasons", "red_flags"]
    return F.coalesce(keys_are(row, fields) & is_count(got("score"), 0, 100) & got("level").isin(levels) & is_reasons(got("reasons")) & is_reasons(got("red_flags")), F.lit(False))


def document_errors(text: Column, source: Column, tools: list[str], names: list[str]) -> Column:
    """What a written document says that its source does not: numbers, tools and names, sorted."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    unknown = F.transform(F.array_except(numbers(text), numbers(source)), lambda x: F.concat(F.lit("number "), x))
    holds = lambda t, w: F.contains(F.lower(t), F.lit(w.lower()))
    words = F.array(*[F.when(holds(text, w) & ~holds(source, w), F.lit(f"{kind} {w}")) for kind, own in (("tool", tools), ("name", names)) for w in own])
    return F.array_sort(F.concat(unknown, F.filter(words, lambda x: x.isNotNull())))


def skill_override(row: Column, vocabulary: list[str]) -> Column:
    """Whether a map of strings is a skill that the vocabulary has, and when it was chosen."""
    got = lambda c: F.try_element_at(row, F.lit(c))
    return F.coalesce(keys_are(row, ["skill", "created_at"]) & got("skill").isin(vocabulary) & is_instant(got("created_at")), F.lit(False))


def usage(row: Column, providers: list[str]) -> Column:
    """Whether a map of strings counts a day's calls of a model."""
    got = lambda c: F.try_element_at(row, F.lit(c))
    counts = ["calls", "tokens_in", "tokens_out"]
    day = got("day").isNotNull() & is_day(got("day"))
    numbers = is_count(got(counts[0])) & is_count(got(counts[1])) & is_count(got(counts[2]))
    return F.coalesce(keys_are(row, ["day", "provider", "model", *counts]) & day & got("provider").isin(providers) & F.length(got("model")).between(1, 80) & numbers, F.lit(False))


def disagreement(row: Column, levels: list[str], kinds: list[str]) -> Column:
    """Whether a map of strings tells where two scorers differ."""
    got = lambda c: F.try_element_at(row, F.lit(c))
    fields = ["id", "job_key", "hash", "python_score", "python_section", "ai_score", "ai_level", "kind", "created_at"]
    keyed = is_count(got("id"), 1) & got("job_key").rlike(JOB_KEY) & got("hash").rlike(HASH)
    scored = is_count(got("python_score"), 0, 100) & is_count(got("ai_score"), 0, 100) & (F.length(got("python_section")) <= 16)
    return F.coalesce(keys_are(row, fields) & keyed & scored & got("ai_level").isin(levels) & got("kind").isin(kinds) & is_instant(got("created_at")), F.lit(False))


def is_counters(value: Column, longest: int = 1000) -> Column:
    """A JSON object of counts."""
    numbers = F.from_json(value, "map<string,string>")
    return F.coalesce((F.length(value) <= longest) & F.json_object_keys(value).isNotNull() & F.forall(F.map_values(numbers), lambda x: is_count(x)), F.lit(False))


def run(row: Column, outcomes: list[str], providers: list[str]) -> Column:
    """Whether a map of strings is a run's record; its HTTP status and provider may be null."""
    got = lambda c: F.try_element_at(row, F.lit(c))
    fields = ["id", "started_at", "finished_at", "outcome", "http_status", "provider", "counters"]
    status = got("http_status").isNull() | is_count(got("http_status"), 100, 599)
    provider = got("provider").isNull() | got("provider").isin(providers)
    return F.coalesce(keys_are(row, fields) & is_count(got("id"), 1) & is_instant(got("started_at")) & is_instant(got("finished_at")) & got("outcome").isin(outcomes) & status & provider & is_counters(got("counters")), F.lit(False))


# --- bodies of API calls: JSON texts, and the first rule that one breaks ---------------------------------


class Body:
    """The fields of a JSON object, each with its kind and its text, read once; an empty text is no value."""

    def __init__(self, opened: Column, fields: list[str]) -> None:
        self.opened, self.fields = opened, fields
        self.parsed, self.keys = opened["parsed"], opened["keys"]

    @staticmethod
    def check(value: Column, fields: list[str], rules: Callable[[Body], list[tuple[str, Column]]]) -> Column:
        """The first rule that a JSON text breaks; null for none."""
        whole = F.struct(F.try_parse_json(value).alias("parsed"), F.json_object_keys(value).alias("keys"))

        def opened(x: Column) -> Column:
            kinds = [F.schema_of_variant(F.try_variant_get(x["parsed"], f"$.{f}", "variant")).alias(f"kind_{f}") for f in fields]
            texts = [F.nullif(F.try_variant_get(x["parsed"], f"$.{f}", "string"), F.lit("")).alias(f"text_{f}") for f in fields]
            return F.struct(x["parsed"].alias("parsed"), x["keys"].alias("keys"), *kinds, *texts)

        return T.let(T.let(whole, opened), lambda s: Body(s, fields).error(*rules(Body(s, fields))))

    def kind(self, field: str) -> Column:
        """VOID for null, null for a field that is not there."""
        return self.opened[f"kind_{field}"]

    def text(self, field: str) -> Column:
        return F.when(self.kind(field) == "STRING", self.opened[f"text_{field}"])

    def absent(self, field: str) -> Column:
        return self.kind(field).isNull() | (self.kind(field) == "VOID") | ((self.kind(field) == "STRING") & self.text(field).isNull())

    def may(self, field: str, test: Column) -> Column:
        """A field that is absent or passes."""
        return self.absent(field) | F.coalesce(test, F.lit(False))

    def error(self, *rules: tuple[str, Column]) -> Column:
        """The message of the first rule that does not hold, after those of the object itself; null for none."""
        known = F.size(F.array_except(self.keys, F.array(*[F.lit(f) for f in self.fields]))) == 0
        every = [("body: must be a JSON object", self.parsed.isNotNull() & self.keys.isNotNull()), ("body: unknown field", known), *rules]
        return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), message) for message, test in every])

    def day(self, field: str) -> tuple[str, Column]:
        return f"{field}: must be YYYY-MM-DD", self.may(field, self.text(field).isNotNull() & is_day(self.text(field)) & self.text(field).between("2000-01-01", "2100-12-31"))


NOTE_CHARS, SENDER_CHARS, MESSAGE_CHARS = 2000, 320, 200


def application_body(value: Column, statuses: list[str]) -> Column:
    def rules(b: Body) -> list[tuple[str, Column]]:
        url = b.text("cv_url").isNotNull() & is_https(b.text("cv_url")) & ~b.text("cv_url").rlike("^[^:]*://[^/]*@")
        note = b.may("note", F.length(b.text("note")) <= NOTE_CHARS)
        return [("status: not an allowed value", b.text("status").isin(statuses)), *[b.day(f) for f in ("applied_at", "follow_up_at", "interview_at")], (f"note: must be text of at most {NOTE_CHARS} characters", note), ("cv_url: must be an https URL", b.may("cv_url", url))]

    return Body.check(value, ["status", "applied_at", "follow_up_at", "interview_at", "note", "cv_url"], rules)


def decision_body(value: Column, labels: list[str]) -> Column:
    def rules(b: Body) -> list[tuple[str, Column]]:
        kind = b.kind("score_at_decision")
        score = (kind == "BIGINT") & F.try_variant_get(b.parsed, "$.score_at_decision", "bigint").between(0, 100)
        return [("job_key: invalid", b.text("job_key").rlike(JOB_KEY)), ("label: not an allowed value", b.text("label").isin(labels)), ("score_at_decision: must be an integer 0-100 or null", kind.isNull() | (kind == "VOID") | score)]

    return Body.check(value, ["job_key", "label", "score_at_decision"], rules)


def message_body(value: Column) -> Column:
    def rules(b: Body) -> list[tuple[str, Column]]:
        ident = F.length(b.text("message_id")).between(1, MESSAGE_CHARS) & ~b.text("message_id").rlike(r"\s")
        day = F.try_to_timestamp(b.text("date")).isNotNull()
        return [("message_id: invalid", ident), ("from: invalid", b.may("from", F.length(b.text("from")) <= SENDER_CHARS)), ("subject: must be text", b.may("subject", b.text("subject").isNotNull())), ("date: must be an ISO date", b.may("date", day)), ("text: must be text", b.kind("text") == "STRING")]

    return Body.check(value, ["message_id", "from", "subject", "date", "text"], rules)


def action_body(value: Column, actions: list[str], kinds: list[str]) -> Column:
    def rules(b: Body) -> list[tuple[str, Column]]:
        whole = (b.text("action") != "correct") | (b.text("application_key").isNotNull() & b.text("kind").isNotNull())
        key, kind = b.may("application_key", b.text("application_key").rlike(JOB_KEY)), b.may("kind", b.text("kind").isin(kinds))
        return [("action: not an allowed value", b.text("action").isin(actions)), ("application_key: invalid", key), ("kind: not an allowed value", kind), b.day("interview_at"), ("correct: needs application_key and kind", whole)]

    return Body.check(value, ["action", "application_key", "kind", "interview_at"], rules)
