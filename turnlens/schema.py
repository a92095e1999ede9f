"""Spark types of the data model: sessions are rows of turns, ordered by ``turn_index``."""

from __future__ import annotations

ROLES = ("User", "Assistant", "System", "ToolResult")

INTENT_DDL = (
    "struct<kind:string,path:string,query:string,is_ast:boolean,tool:string,pattern:string,runner:string,"
    "target_suite:string,action:string,agent_type:string,description:string,server:string,method:string,"
    "raw_name:string,line_from:bigint,line_to:bigint,lines_added:bigint,lines_removed:bigint>"
)
CALLS_DDL = f"array<struct<call_id:string,tool_name:string,intent:{INTENT_DDL},raw_arguments:string>>"
RESULTS_DDL = (
    "array<struct<call_id:string,output_bytes:bigint,line_count:bigint,is_error:boolean,error_class:string,"
    "truncated_output:string,otel_span_id:string>>"
)
USAGE_DDL = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_tokens:bigint,cache_read_tokens:bigint,reasoning_tokens:bigint>"
ATTRIBUTION_DDL = "struct<kind:string,name:string,plugin:string>"

TURNS_DDL = (
    "session_key string, provider string, session_id string, parent_session_id string, subagent_role string,"
    "turn_index bigint, role string, ts timestamp, latency_ms bigint, text string,"
    f"tool_calls {CALLS_DDL}, tool_results {RESULTS_DDL}, usage {USAGE_DDL}, attribution {ATTRIBUTION_DDL},"
    "model string, service_tier string"
)
LINES_DDL = "file_path string, line_number bigint, byte_offset bigint, value string"
FAILURES_DDL = "file_path string, line_number bigint, byte_offset bigint, error string"
