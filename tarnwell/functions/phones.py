"""Numbers, addresses, names and room fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.text import ColumnLike, blank_to_null, col, split_features

# Accepted shapes.
E164_PATTERN = r"^\+[1-9]\d{1,14}$"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
DIGITS_PATTERN = r"^\d+$"
AGENT_NAME_PATTERN = r"(?U)^[\p{L}\p{N}_-]+$"
WORKER_PREFIX = "agent-worker-"


def is_e164(value: ColumnLike) -> Column:
    return F.coalesce(col(value).rlike(E164_PATTERN), F.lit(False))


def is_uuid(value: ColumnLike) -> Column:
    return F.coalesce(col(value).rlike(UUID_PATTERN), F.lit(False))


def normalize_msisdn(value: ColumnLike) -> Column:
    """Digits with an optional leading plus removed; null when anything else is in it."""
    bare = F.regexp_replace(F.trim(col(value)), r"^\+", "")
    return F.when(bare.rlike(DIGITS_PATTERN), bare)


def is_msisdn(value: ColumnLike) -> Column:
    return F.coalesce(normalize_msisdn(value).isNotNull(), F.lit(False))


def to_e164(value: ColumnLike) -> Column:
    return F.concat(F.lit("+"), normalize_msisdn(value))


def sip_uri(value: ColumnLike) -> Column:
    raw = blank_to_null(value)
    return F.when(F.startswith(raw, F.lit("sip:")), raw).otherwise(F.concat(F.lit("sip:"), raw))


def transfer_destination(value: ColumnLike) -> Column:
    """sip: addresses pass, numbers become tel: addresses, everything else is null."""
    raw = F.trim(col(value))
    number = F.regexp_replace(raw, "^tel:", "")
    return F.when(F.startswith(raw, F.lit("sip:")), raw).when(
        number.rlike(E164_PATTERN), F.concat(F.lit("tel:"), number)
    )


def transfer_reject_reason(value: ColumnLike) -> Column:
    raw = F.trim(F.coalesce(col(value), F.lit("")))
    return F.when(raw == "", F.lit("destination missing")).when(
        transfer_destination(raw).isNull(), F.lit("number is not E.164")
    )


def worker_slug(name: ColumnLike, prefix: str = WORKER_PREFIX) -> Column:
    dashed = F.regexp_replace(F.lower(col(name)), r"[^a-z0-9-]+", "-")
    return F.concat(F.lit(prefix), F.btrim(F.regexp_replace(dashed, r"-+", "-"), F.lit("-")))


def image_tag(ref: ColumnLike) -> Column:
    """Digest after the first ``@``, else the tag of the last path part, else null."""
    value = col(ref)
    last = F.substring_index(value, "/", -1)
    return F.when(F.contains(value, F.lit("@")), F.regexp_extract(value, "@(.*)$", 1)).when(
        F.contains(last, F.lit(":")), F.substring_index(value, ":", -1)
    )


def room_part(room_name: ColumnLike, index: int) -> Column:
    return F.coalesce(F.try_element_at(F.split(col(room_name), "_"), F.lit(index)), F.lit(""))


def room_phone(room_name: ColumnLike) -> Column:
    return room_part(room_name, 2)


def room_call_id(room_name: ColumnLike) -> Column:
    return room_part(room_name, 3)


def _attribute(attributes: ColumnLike, key: str) -> Column:
    value = F.try_element_at(col(attributes), F.lit(key))
    return F.when(value != "", value)


def session_fields(
    room_name: ColumnLike, participant_kind: ColumnLike, identity: ColumnLike, attributes: ColumnLike
) -> Column:
    """One struct of the resolved session values; a blank attribute counts as absent."""
    kind = F.when(col(participant_kind) == "sip", F.lit("sip")).otherwise(
        F.coalesce(_attribute(attributes, "channel"), F.lit("webrtc"))
    )

    def or_null(value: Column) -> Column:
        return F.when(value != "", value)

    return F.struct(
        kind.alias("session_type"),
        F.when(kind == "sip", col(identity)).alias("participant_identity"),
        F.coalesce(
            _attribute(attributes, "sip.phoneNumber"),
            _attribute(attributes, "phone_number"),
            or_null(room_phone(room_name)),
        ).alias("phone_number"),
        F.coalesce(
            _attribute(attributes, "transfer_phone_number"),
            _attribute(attributes, "transfer.phoneNumber"),
            _attribute(attributes, "transfer.to_phone_number"),
        ).alias("transfer_phone_number"),
        F.coalesce(_attribute(attributes, "sip.callID"), or_null(room_call_id(room_name))).alias("call_id"),
    )


def normalize_agent_name(name: ColumnLike) -> Column:
    """Trimmed lower-case name with underscores; null when other characters remain."""
    value = F.replace(F.lower(F.trim(col(name))), F.lit(" "), F.lit("_"))
    return F.when(value.rlike(AGENT_NAME_PATTERN), value)


def phone_if_sip(channel: ColumnLike, phone: ColumnLike) -> Column:
    return F.when(col(channel) == "sip", col(phone))


def call_end_status(reason: ColumnLike) -> Column:
    return F.when(col(reason) == "assistant-forwarded-call", F.lit("transferred")).otherwise(F.lit("ended"))


def number_record(
    country: ColumnLike,
    default_country: ColumnLike,
    msisdn: ColumnLike,
    features: ColumnLike,
    number_type: ColumnLike,
    other_type: ColumnLike,
    cost: ColumnLike,
) -> Column:
    """Normalised record of a phone number offer."""
    digits = normalize_msisdn(msisdn)
    return F.struct(
        F.upper(F.coalesce(F.when(col(country) != "", col(country)), col(default_country))).alias("country"),
        digits.alias("msisdn"),
        split_features(features).alias("features"),
        F.coalesce(
            F.when(col(number_type) != "", col(number_type)), col(other_type), F.lit("")
        ).alias("number_type"),
        blank_to_null(cost).alias("cost"),
        F.concat(F.lit("+"), digits).alias("e164"),
    )
