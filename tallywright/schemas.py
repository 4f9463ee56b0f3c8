"""Schemas of the records, and fixed values of the service whose data these are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: Fields of a product and of a record (fixed values).
PRODUCT_FIELDS = ("product_id", "product_name", "product_unit_price", "product_quantity", "product_discount_money", "product_total_money")
BASE_FIELDS = ("name", "type", "date", "time", "pos_id", "receipt_number", "cashier", "total_money", "barcode")
#: Product fields that scoring looks at: the discount is not one of them.
SCORED_PRODUCT_FIELDS = ("product_id", "product_name", "product_unit_price", "product_quantity", "product_total_money")

PRODUCT = T.StructType(_strings(*PRODUCT_FIELDS))
INVOICE = T.StructType([*_strings(*BASE_FIELDS), T.StructField("products", T.ArrayType(PRODUCT))])
#: Labelled records: absent keys are null. Older labels name two product fields otherwise.
GOLD = T.StructType([
    *_strings("file", "_verify_status", *BASE_FIELDS, "campaign_id", "total_original_money", "total_discount_money"),
    T.StructField("products", T.ArrayType(T.StructType([*PRODUCT.fields, *_strings("product_code", "product_amount")]))),
])
JOB = T.StructType([
    *_strings("job_id", "status", "phash", "image_url"), T.StructField("result", INVOICE), *_strings("error_code", "error_message"),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])
MESSAGE = T.StructType(_strings("job_id", "image_url"))

#: States of a job (fixed values).
PENDING, PROCESSING, SUCCEEDED = "PENDING", "PROCESSING", "SUCCEEDED"
FAILED_PERMANENT, FAILED_TRANSIENT = "FAILED_PERMANENT", "FAILED_TRANSIENT"
STATUSES = (PENDING, PROCESSING, SUCCEEDED, FAILED_PERMANENT, FAILED_TRANSIENT)
TERMINAL = (SUCCEEDED, FAILED_PERMANENT, FAILED_TRANSIENT)
#: Error code and whether the failure is permanent (fixed values).
ERRORS = (
    ("unsupported_media_type", True), ("payload_too_large", True), ("extractor_invalid_json", True), ("no_invoice_detected", True),
    ("image_download_failed", True), ("image_too_large", True), ("truncated_upload", True), ("prompt_missing", True),
    ("yolo_degenerate_box", True), ("yolo_bad_output_shape", True), ("orphan_requeue_cap", True),
    ("gemini_client_error", True), ("gemini_api_key_missing", True),
    ("rate_limited_locally", False), ("gemini_exhausted", False), ("triton_unavailable", False), ("storage_transient", False),
    ("database_unavailable", False), ("stale_timeout", False),
)


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows, with the service's defaults (fixed values); passed on explicitly."""

    cache_ttl_s: int = 86_400
    requeue_ttl_s: int = 3_600
    requeue_cap: int = 3
    reject_depth: int = 500
    warn_depth: int = 200
    retry_after_s: int = 5
    max_image_bytes: int = 10 * 1024 * 1024
    confidence: float = 0.35
    box_margin: float = 0.02
    input_size: int = 640
    processing_stale_min: int = 15
    pending_stale_min: int = 30
    retention_days: int = 90
    rate_per_s: float = 4.0
    burst: int = 8
    retries: int = 3
    backoff_s: tuple[float, ...] = (0.3, 0.6, 1.2)
    store_cutoff: float = 80.0
    store_fallback: float = 60.0
    product_cutoff: float = 70.0
    test_ratio: float = 0.30
    allowed_domains: tuple[str, ...] = ("example.com", "example.net")


DEFAULTS = Settings()
