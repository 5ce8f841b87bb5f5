"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schemas as S

#: Fixed value: the URL namespace of name-based ids.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def priority_score(impact: Column, urgency: Column, specificity: Column, confidence: Column) -> Column:
    """Weighted sum of three 1-5 scores and a confidence, to three places."""
    return F.round(0.40 * impact / 5 + 0.35 * urgency / 5 + 0.15 * specificity / 5 + 0.10 * confidence, 3)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_name(name: Column) -> Column:
    return F.lower(collapse(name))


def truthy(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def share_filled(columns: list[Column]) -> Column:
    """Non-empty texts among the given, as a share."""
    return sum((truthy(c).cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def scored_share(scores: Column, of: int | None = None) -> Column:
    """Non-null values of a score map, out of its own size or a fixed number; 0 for none."""
    n = F.size(F.filter(F.map_values(scores), lambda v: v.isNotNull()))
    total = F.lit(of) if of else F.size(scores)
    return F.when(total > 0, n / total).otherwise(0.0)


def uuid5(name: Column) -> Column:
    """Name-based id (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.substring(h, 17, 1)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(nibble, 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_hash(*columns: Column) -> Column:
    """First 16 hex digits of the sha-256 of the values as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def reference(id_: Column) -> Column:
    """Short deal reference: the last 16 hex digits of its id."""
    return F.concat(F.lit("deal_"), F.right(F.replace(id_, F.lit("-"), F.lit("")), F.lit(16)))


def workflow_id(pipeline: str, interaction: Column) -> Column:
    return F.concat(F.lit(f"{pipeline}:interaction-"), interaction)


def relational_status(status: Column) -> Column:
    """Status in the relational mirror; pending for open and for anything unknown."""
    out = F.lit("pending")
    for k, v in S.RELATIONAL_STATUS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def implied_status(is_update: Column, implied: Column) -> Column:
    return F.when(is_update & implied.isin(S.IMPLIED_STATUSES), implied).otherwise("open")


def new_stage(stage: Column) -> Column:
    """Stage of a new deal: prospecting unless known."""
    return F.when(stage.isin(S.DEAL_STAGES), stage).otherwise("prospecting")


def next_stage(old: Column, new: Column) -> Column:
    """Stage after an update: an unknown one changes nothing."""
    return F.when(new.isin(S.DEAL_STAGES), new).otherwise(old)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))), F.lit("]"))


def parse_time(text: Column) -> Column:
    """ISO time, null if it is none."""
    return F.try_to_timestamp(text)


def valid_uuid(text: Column) -> Column:
    return F.when(F.lower(text).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text)


def clip(text: Column, n: int = 2000) -> Column:
    return F.substring(text, 1, n)


def model_error(message: Column) -> Column:
    """Class of a failed model call by its message."""
    m = F.lower(message)
    return F.when(m.rlike("rate limit|rate_limit"), "rate_limit").when(m.rlike("content policy|refused"), "refused").otherwise("model_error")


def store_error(message: Column) -> Column:
    """Class of a failed store call by its message."""
    m = F.lower(message)
    return F.when(m.rlike("connect"), "connection").when(m.rlike("constraint|unique"), "constraint").otherwise("query")


def word_boundary_match(a: Column, b: Column) -> Column:
    """The shorter name stands as whole words in the strictly longer one, in any case."""
    inside = lambda short, long: F.rlike(long, F.concat(F.lit(r"(?iuU)\b\Q"), short, F.lit(r"\E\b")))
    return F.when(F.length(a) < F.length(b), inside(a, b)).when(F.length(a) > F.length(b), inside(b, a)).otherwise(F.lit(False))


def loose_affix_match(a: Column, b: Column) -> Column:
    """One name, of three letters or more, starts or ends the other or stands in it beside a space."""
    a, b = F.lower(a), F.lower(b)
    space = F.lit(" ")
    one = lambda x, y: (F.length(y) >= 3) & (F.startswith(x, y) | F.endswith(x, y) | F.contains(x, F.concat(space, y)) | F.contains(x, F.concat(y, space)))
    return one(a, b) | one(b, a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero. Norms may be given, to compute each once a row."""
    both = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def scaled(score: Column, scale: str = "cosine") -> Column:
    """A raw cosine on the scale asked for: cosine, or unit_interval for (1 + cosine) / 2."""
    if scale not in ("cosine", "unit_interval"):
        raise ValueError(f"unknown scale {scale}")
    return score if scale == "cosine" else (1 + score) / 2


def contact_label(c: Column) -> Column:
    """Name <email> (role), or name (role), or email (role)."""
    text = lambda x: F.coalesce(c[x], F.lit(""))
    role = F.concat(F.lit(" ("), text("role"), F.lit(")"))
    named = F.when(truthy(c["email"]), F.concat(c["name"], F.lit(" <"), c["email"], F.lit(">"), role)).otherwise(F.concat(c["name"], role))
    return F.when(truthy(c["name"]), named).otherwise(F.concat(text("email"), role))


def contact_name(c: Column) -> Column:
    return F.when(truthy(c["name"]), c["name"]).otherwise(F.coalesce(c["email"], F.lit("Unknown")))


def normalised_fields(fields: Column, rename: dict[str, str], allowed: list[str]) -> Column:
    """Field names renamed and then kept if allowed; order and repeats stay."""
    pairs = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
    return F.filter(F.transform(fields, lambda x: F.coalesce(F.try_element_at(pairs, x), x)), lambda x: x.isin(allowed))


def flatten_struct(prefix: str, column: str, names: list[str]) -> list[Column]:
    return [F.col(column)[n].alias(f"{prefix}{n}") for n in names]


def dimensions(scores: Column, ids: list[str]) -> list[Column]:
    """Two columns for each dimension of a map of (score, confidence, evidence); a score without confidence has 0."""
    out = []
    for i in ids:
        d = F.try_element_at(scores, F.lit(i))
        out += [d["score"].alias(f"dim_{i}"), F.when(d["score"].isNotNull(), F.coalesce(d["confidence"], F.lit(0.0))).alias(f"dim_{i}_confidence")]
    return out


def json_or_null(m: Column) -> Column:
    return F.when(F.size(m) > 0, F.to_json(m))


def properties(**columns: Column) -> Column:
    """A node's stored properties as JSON: null ones are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), {"ignoreNullFields": "true"})


def or_default(text: Column, default: str = "Not identified") -> Column:
    """Text for a prompt: a default where it is null or empty."""
    return F.when(truthy(text), text).otherwise(F.lit(default))


def template(text: str, **values: Column) -> Column:
    """A prompt: ``{name}`` in the text stands for a value; nulls are empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def overlay(props: Column, updates: Column) -> Column:
    """A property map under a map of updates: an update replaces, a null update removes its key."""
    empty = F.create_map().cast("map<string,string>")
    p, u = F.coalesce(props, empty), F.coalesce(updates, empty)
    kept = F.map_filter(p, lambda k, _: ~F.map_contains_key(u, k))
    return F.map_concat(kept, F.map_filter(u, lambda _, v: v.isNotNull()))


def merged_share(merged: Column, existing: Column, of: list[str]) -> Column:
    """Share of the given keys that have a value in either of two score maps."""
    has = lambda m, k: F.try_element_at(m, F.lit(k)).isNotNull()
    return sum((F.coalesce(has(merged, k) | has(existing, k), F.lit(False)).cast("int") for k in of), F.lit(0)) / F.lit(float(len(of)))
