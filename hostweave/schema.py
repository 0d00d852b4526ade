"""Column types of the tables the library reads and writes."""

from __future__ import annotations

ENVELOPE = (
    "schema_ver string, event_id string, producer_id string, host_id string, ts_utc string, nonce string, "
    "payload_type string, payload string, hmac string"
)
PAYLOAD = (
    "user string, result string, src string, dst_ip string, dst_port string, bytes string, egress string, blocked string, "
    "image string, pid string, query string, qtype string, command_line string, script_sha256_16 string, technique string, "
    "channel string, provenance string"
)
STAGE = "struct<name:string,hosts:array<string>>"
TRUTH = f"campaign_id string, host_ids array<string>, stages array<{STAGE}>, family string, ood boolean"
STEP = (
    "struct<kind:string,type:string,host:string,offset_seconds:double,user:string,src:string,dst_ip:string,dst_port:int,"
    "bytes:bigint,dst_ips:array<string>,dst_step:double,query:string,qtype:string,emit_host:string,host_id_override:string,"
    "clock_skew_seconds:double,technique:string,note:string>"
)
MANIFEST = (
    f"campaign_id string, family string, ood boolean, hosts array<string>, producers map<string,string>, base_time_utc string, "
    f"steps array<{STEP}>, truth_hosts array<string>, truth_campaigns array<struct<id:string,hosts:array<string>>>, "
    "host_aliases map<string,string>, host_clock_skew_seconds map<string,double>, drop_hosts array<string>, "
    "reference_jaccard double, break_intent string, host_roles map<string,string>"
)
REQUIRED_ENVELOPE = (
    "schema_ver", "event_id", "producer_id", "host_id", "ts_utc", "nonce", "payload_type", "payload", "hmac",
)
