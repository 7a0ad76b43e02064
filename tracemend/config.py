"""Settings of a repair run: defaults, what single logs change, and where logs lie."""

from __future__ import annotations

from typing import Any

# The defaults of a run.
DEFAULTS: dict[str, Any] = {
    "latent_dim": 32, "hidden_dims": [128, 64], "window_size": 10, "n_min": 15, "n_reliable": 40, "alpha": 0.5, "fuzzifier": 2.0, "lambda_exp": 1.0, "sparsity_lambda": 0.01,
    "noise_std": 0.1, "warmup_events": 1000, "embedding_dim": 8, "max_lifecycle_categories": 20, "training_epochs": 100, "learning_rate": 0.001, "auto_calibrate": False,
    "confidence_mode": "entropy", "delta": 2.0, "retrain_interval": 1000, "enable_synthetic_reconciliation": True, "synthetic_merge_threshold": 2.0, "drift_decay_factor": 0.5,
    "cf_feature_mode": "prev_only", "disable_iot_features": False, "undiscovered_n_new": 10, "undiscovered_persist_time": 5, "undiscovered_separation": 3.0,
    "candidate_match_threshold": 2.0, "candidate_min_members": 3, "candidate_max_members_stored": 200, "epsilon": 1e-4,
}

_COUNTS = {"enable_sequence_head": True, "enable_count_cache": True, "count_cache_order": 3}
_PLAIN = {"disable_iot_features": True, **_COUNTS}  # logs without sensors
_WIDE = {"hidden_dims": [256, 128]}
_DEEP = {"window_size": 20, "sequence_hidden_dim": 128, "sequence_num_layers": 2, "alpha_seq": 0.30}
_TRAVEL = ["Amount", "BudgetNumber", "org:resource", "Permit"]
_INCIDENT = ["org:group", "org:role", "organization involved"]

# What a log changes.
LOGS: dict[str, dict[str, Any]] = {
    "chess": {"warmup_events": 3000, "n_min": 20, "n_reliable": 50, "warmup_stability_window": 1000, "data_attribute_keys": ["concept:endpoint", "cpee:activity_uuid"]},
    "cottoncandy": {"warmup_events": 7000, "warmup_stability_window": 5000, "data_attribute_keys": ["concept:endpoint", "cpee:activity_uuid"], "enable_sequence_head": False},
    "cyberseciot": {"warmup_events": 2000, "latent_dim": 48, "data_attribute_keys": ["org:resource", "process:exe", "process:path"], **_WIDE, **_DEEP, **_COUNTS},
    "mimiciv": {"warmup_events": 5000, "latent_dim": 64, "data_attribute_keys": ["org:resource", "measurement_context", "category"], "enable_sequence_head": False, **_WIDE},
    "smartfactory": {"warmup_events": 5000, "warmup_stability_window": 1000, "data_attribute_keys": ["requested_service_url", "lifecycle:state", "current_task"], "enable_sequence_head": False},
    "vienna": {"warmup_events": 2000, "latent_dim": 64, "data_attribute_keys": [], **_WIDE, **_DEEP, **_COUNTS},
    "bpic2013_closed": {"warmup_events": 1000, "data_attribute_keys": _INCIDENT, **_PLAIN},
    "bpic2013_open": {"warmup_events": 500, "data_attribute_keys": _INCIDENT, **_PLAIN},
    "bpic2013_incidents": {"warmup_events": 10000, "data_attribute_keys": [*_INCIDENT, "impact"], **_PLAIN},
    "bpic2012": {"warmup_events": 40000, "latent_dim": 48, "data_attribute_keys": ["AMOUNT_REQ", "org:resource"], **_WIDE, **_PLAIN},
    "bpic2017": {"warmup_events": 200000, "latent_dim": 64, "data_attribute_keys": ["Action", "ApplicationType", "LoanGoal", "Selected", "Accepted", "org:resource", "EventOrigin"], **_WIDE, **_PLAIN},
    "bpic2020_domestic": {"warmup_events": 8000, "data_attribute_keys": _TRAVEL, **_PLAIN},
    "bpic2020_international": {"warmup_events": 10000, "data_attribute_keys": _TRAVEL, **_PLAIN},
    "bpic2020_permit": {"warmup_events": 12000, "data_attribute_keys": _TRAVEL, **_PLAIN},
    "bpic2020_prepaid": {"warmup_events": 3000, "data_attribute_keys": _TRAVEL, **_PLAIN},
    "bpic2020_request": {"warmup_events": 6000, "data_attribute_keys": _TRAVEL, **_PLAIN},
    "sepsis": {"warmup_events": 3000, "data_attribute_keys": ["org:group", "InfectionSuspected", "DiagnosticBlood", "Hypotensie", "Hypoxie", "SIRSCritTachypnea", "SIRSCritHeartRate", "SIRSCritTemperature"], **_PLAIN},
    "road_traffic_fine": {"warmup_events": 80000, "latent_dim": 48, "data_attribute_keys": ["amount", "paymentAmount", "totalPaymentAmount", "org:resource", "dismissal", "vehicleClass"], **_WIDE, **_PLAIN},
    "wabo": {"warmup_events": 1500, "data_attribute_keys": ["org:resource", "org:group"], **_PLAIN},
    "helpdesk": {"warmup_events": 3000, "data_attribute_keys": ["seriousness", "customer", "product", "responsible_section", "service_level", "service_type", "support_section", "workgroup"], **_PLAIN},
}

#: folders of logs below a root
PATHS = {name: f"{name}/" for name in ("chess", "cottoncandy", "vienna", "cyberseciot", "mimiciv", "smartfactory")}


def get(log: str | None = None, **changes: Any) -> dict[str, Any]:
    """The settings of a log, or the defaults for an unknown one, with `changes` on top; a copy of its own."""
    return {k: list(v) if isinstance(v, list) else v for k, v in (DEFAULTS | LOGS.get(log or "", {}) | changes).items()}


def path(root: str, log: str) -> str:
    return f"{root.rstrip('/')}/{PATHS.get(log, log + '/')}"


def gates(settings: dict[str, Any]):
    """The decision's gates from settings."""
    from tracemend.operators.cascade import Gates

    s = settings
    cached = s.get("enable_count_cache", False)
    alpha = s["alpha"]
    return Gates(
        alpha_cluster=s.get("alpha_cluster", alpha), alpha_seq=s.get("alpha_seq", alpha) if s.get("enable_sequence_head") else 2.0, margin=s.get("margin_threshold", 0.0), prior_beta=s.get("class_prior_beta", 0.0),
        arbitration=s.get("arbitration", False), arbitration_margin=s.get("arbitration_margin", 0.05), agreement={False: "", True: "argmax"}.get(s.get("enable_agreement_gating", False), s.get("enable_agreement_gating")),
        agreement_k=s.get("agreement_topk", 3), agreement_override=s.get("agreement_high_conf_override", 1.01), alpha_seq_high=s.get("alpha_seq_high", 0.7),
        override=(s.get("count_cache_override_dominance", 0.90), s.get("count_cache_override_support", 20)) if cached else None,
        emit=(s.get("count_cache_emit_dominance", 0.95), s.get("count_cache_emit_support", 50)) if cached else None, n_min=s["n_min"], n_reliable=s["n_reliable"], strength=s["lambda_exp"], mode=s["confidence_mode"],
    )
