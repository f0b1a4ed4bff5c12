"""Declared schemas of the stored model tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()
_MAP = T.MapType(_S, T.LongType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CUSTOMERS = _table(
    customer_id=_S, external_id=_S, name=_S, phone_hash=_S, city=_S, consent_given=_B,
    is_active=_B, is_provisional=_B, created_at=_TS, last_seen_at=_TS,
)
TRANSACTIONS = _table(
    tx_id=_S, customer_id=_S, tx_date=_TS, service_type=_S, amount=T.DecimalType(12, 2), status=_S,
)
MESSAGES = _table(
    msg_id=_S, phone_number=_S, direction=_S, text=_S, timestamp=_TS, raw_meta=T.MapType(_S, _S),
)
LINKS = _table(
    link_id=_S, msg_id=_S, customer_id=_S, match_confidence=_D, match_method=_S, link_status=_S, linked_at=_TS,
)
MESSAGE_FEATURES = _table(
    feature_id=_S, link_id=_S, msg_id=_S, customer_id=_S, msg_length=_I, num_exclamations=_I, num_questions=_I,
    embedding=T.ArrayType(T.FloatType()), embedding_model_version=_S, has_complaint=_B, has_refund_request=_B,
    response_time_secs=_I, processed_at=_TS,
)
TEXT_SEMANTICS = _table(
    customer_id=_S, as_of_date=_DATE, top_topic_counts=_MAP, avg_topic_similarity=_D, topic_model_version=_S,
    sentiment_dist=_MAP, avg_sentiment_score=_D, sentiment_model_version=_S, top_keywords=_MAP,
    top_complaint_types=_MAP,
    last_n_msg_ids=T.ArrayType(_table(msg_id=_S, timestamp=_TS)),
)
PREDICTIONS = _table(
    pred_id=_S, customer_id=_S, churn_score=_D, churn_label=_S, model_version=_S, as_of_date=_DATE, created_at=_TS,
    features_used=T.ArrayType(_D), feature_as_of=_TS, feature_schema_hash=_S, model_hash=_S,
)
CONTRIBUTION = _table(feature=_S, value=_D, contribution=_D)
TOPICS = _table(topic_id=_S, topic_idx=_I, name=_S, top_keywords=T.ArrayType(_S), model_version=_S, created_at=_TS)
ACTIONS = _table(
    action_id=_S, pred_id=_S, customer_id=_S, action_type=_S, priority=_S, assigned_to=_S, status=_S, notes=_S,
    due_date=_DATE, created_at=_TS,
)
