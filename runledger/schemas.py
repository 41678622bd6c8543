"""Schemas of the canonical tables."""

from __future__ import annotations

# Job states, and the one that only reports use.
PENDING, ACTIVE, COMPLETED, FAILED = "PENDING", "ACTIVE", "COMPLETED", "FAILED"
NOT_FOUND = "NOT_FOUND"

GENERATION_PARAMS = "struct<max_new_tokens:int,temperature:double,do_sample:boolean>"

RUNS = "run_id string, strategy string, run_start_us bigint, run_end_us bigint"

SUBMISSIONS = (
    "run_id string, seq bigint, event_type string, submitted_us bigint, job_id string, "
    "request_id string, dataset_samples array<string>, max_steps int, batch_size int, "
    "lr double, adapter_save_path string"
)

JOBS = (
    "run_id string, job_id string, reg_seq bigint, status string, start_us bigint, end_us bigint, "
    "current_step bigint, max_steps int, error_message string"
)

JOB_EVENTS = (
    "run_id string, job_id string, event_seq bigint, event_type string, ts_us bigint, "
    "step_increment int, loss_raw string, status string, error_message string"
)

REQUESTS = (
    "run_id string, request_id string, submission_us bigint, prompt string, "
    f"adapter_path string, generation_params {GENERATION_PARAMS}"
)

RESULTS = (
    "run_id string, request_id string, submission_us bigint, processing_start_us bigint, "
    "processing_end_us bigint, output string, error string"
)

SAMPLES = "job_id string, sample_idx bigint, text string"

ADAPTER_FILES = "path string, size bigint"

# One run report as nested JSON.
REPORT = (
    "run_id string, run_timestamp string, strategy string, strategy_params map<string,string>, "
    "config_used variant, total_monitor_time_seconds double, summary_metrics map<string,double>, "
    "training_job_details map<string,struct<status:string,start_time:double,end_time:double,"
    "duration_seconds:double,final_step:bigint,error:string>>, "
    "inference_request_details array<struct<request_id:string,submission_time:double,"
    "processing_start_time:double,processing_end_time:double,output:string,error:string>>"
)

ADAPTER_CONFIG = (
    "base_model_name_or_path string, peft_type string, task_type string, r int, lora_alpha int, "
    "lora_dropout double, target_modules array<string>, bias string"
)
