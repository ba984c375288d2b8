"""The engine's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

ITEM = "struct<idx:int,reward:double,landings:int,per_seed:array<double>,seed:int,success:boolean,regret:double,best_bit:int,advantage:double,error:string>"

TABLES = {
    "batches": "id string, name string, env_name string, cmd string, payload string, total_chunks int, completed_chunks int, status string, submitter string, best_reward double, baseline_reward double, n_results int, sum_reward double, sum_sq_reward double, last_result_at timestamp, master_polled_at timestamp, experiment_id string, inserted_at timestamp, updated_at timestamp, completed_at timestamp",
    "chunk_jobs": "id bigint, queue string, state string, priority int, scheduled_at timestamp, attempted_at timestamp, attempt int, max_attempts int, chunk_id string, batch_id string, chunk_index int, adapter string, candidates array<string>",
    "chunk_results": f"batch_id string, chunk_index int, results array<{ITEM}>, inserted_at timestamp",
    "workers": "id string, name string, hostname string, pool_size int, version string, registered_at timestamp, last_heartbeat_at timestamp, jobs_completed int, candidates_evaluated bigint, status string, capabilities array<string>",
    "batch_contributions": "batch_id string, worker_id string, display_name string, chunks_completed int, candidates_evaluated bigint, first_chunk_at timestamp, last_chunk_at timestamp",
    "experiments": "id string, env_name string, env_key string, submitter string, config string, status string, current_cegar_iter int, current_iter int, baseline_reward double, best_reward double, accepted_count int, started_at timestamp, completed_at timestamp, error string, env_policy_id string, inserted_at timestamp, updated_at timestamp",
    "env_policies": "id string, env_name string, env_key string, config_sig string, config_data string, predicates array<string>, policy_version int, best_reward double, baseline_reward double, validation_avg double, validation_version int, n_episodes int, first_seen_at timestamp",
    "policy_versions": "id string, env_policy_id string, experiment_id string, version int, predicates array<string>, bit_idx int, prev_reward double, new_reward double, worker_id string, inserted_at timestamp",
    "system_events": "id string, level string, source string, message string, env_name string, experiment_id string, metadata string, inserted_at timestamp",
}
SCHEMAS = {name: StructType.fromDDL(ddl) for name, ddl in TABLES.items()}
STATUSES = {"batch": ("pending", "running", "completed", "failed", "cancelled"), "worker": ("active", "inactive"), "level": ("info", "warning", "error")}
