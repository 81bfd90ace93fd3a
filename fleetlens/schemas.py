"""Declared schemas of every input the engine reads."""

from __future__ import annotations

RANGE_RESPONSE = (
    "struct<status string, data struct<resultType string, "
    "result array<struct<metric map<string,string>, values array<array<string>>>>>>"
)

ENVELOPE = "struct<code int, message string, result string, trace_id string, version string>"

CONFIG = "struct<max_num_seqs int, tensor_parallel_size int, gpu_memory_utilization double, replicas int>"

HISTORY_RECORD = (
    f"struct<timestamp bigint, isAnomaly boolean, configRecommendResult {CONFIG}, currentConfig {CONFIG}>"
)

# The columns of a load log that are read; logs hold more.
LOAD_REPORT = "elapsed double, success boolean"

OTLP_TRACES = (
    "resourceSpans array<struct<resource struct<attributes array<struct<key string, value map<string,string>>>>, "
    "scopeSpans array<struct<spans array<struct<traceId string, spanId string, parentSpanId string, name string, "
    "kind int, startTimeUnixNano string, endTimeUnixNano string, status struct<code int>, "
    "attributes array<struct<key string, value map<string,string>>>>>>>>>"
)

TEST_SPEC = (
    "struct<data_set string, duration int, duration_unit string, distribution string, "
    "tps_mean double, tps_std double>"
)
PARAM_SPEC = "struct<max_tokens int, temperature double, top_p double, others string>"
TEST_RESULT = "struct<total bigint, success bigint, elasped_avg double>"

INSTANCE_JSON = {
    "instance_spec": "map<string,string>",
    "startup_args": "map<string,string>",
    "mdl_cfg": "map<string,string>",
    "extra": "map<string,string>",
}
TEST_JSON = {"param_spec": PARAM_SPEC, "test_spec": TEST_SPEC, "result": TEST_RESULT}
