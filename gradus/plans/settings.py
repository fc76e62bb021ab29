"""Settings of an online run, from a nested configuration."""

from __future__ import annotations

from gradus.sources.records import config_get

#: field: (kind, default, paths of which the first that is there counts). A ? marks kinds that may be null (fixed values).
ROLLOUT = {
    "max_prompt_tokens": ("int", 1024, "rollout.max_prompt_tokens"),
    "max_response_tokens": ("int", 512, "rollout.max_response_tokens", "generation.max_response_tokens", "generation.max_new_tokens"),
    "temperature": ("float", 0.8, "rollout.temperature", "generation.temperature"),
    "top_p": ("float", 0.95, "rollout.top_p", "generation.top_p"),
}
OPTIMIZER = {"learning_rate": ("float", 1e-6), "weight_decay": ("float", 0.0), "warmup_steps": ("int", 0), "gradient_accumulation_steps": ("int", 1), "max_grad_norm": ("float", 1.0)}
LOSS = {"clip_epsilon": ("float", 0.2), "kl_beta": ("float", 0.0), "max_log_ratio": ("float", 20.0)}
CRITIC_LOSS = {"value_clip_epsilon": ("float?", 0.2), "value_loss_coef": ("float", 0.5), "entropy_coef": ("float", 0.0), "gamma": ("float", 1.0), "gae_lambda": ("float", 1.0), "normalize_advantages": ("bool", True)}
TRAINING = {"max_batches": ("int?", None), "step_scheduler": ("bool", True), "pad_token_id": ("int", 0), "device": ("str?", None), "microbatch_size": ("int", 0)}
BATCH = {"max_prompt_tokens": ("int?", None), "max_response_tokens": ("int?", None), "response_source": ("str", "raw_completion"), "include_failed_parses": ("bool", True), "prompt_truncation_side": ("str", "left"), "response_truncation_side": ("str", "right")}
EVALUATION = {"samples_per_task": ("int", 1), "temperature": ("float", 0.0), "top_p": ("float", 1.0), "include_hidden": ("bool", True), "ks": ("ints", (1,))}
REVISION = {"max_revisions": ("int", 1), "revision_prompt_template": ("str", "self_debug_revision_v1"), "revision_reward_discount": ("float", 1.0), "revision_reward_discount_mode": ("str", "positive_only"), "revision_reward_step_penalty": ("float", 0.0), "revision_max_new_tokens": ("int?", None), "revision_temperature": ("float?", None), "revision_top_p": ("float?", None)}
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")

_ABSENT = object()


def _bool(v) -> bool:
    said = v.strip().lower() if isinstance(v, str) else None
    return True if said in TRUE else False if said in FALSE else bool(v)


def _ints(v) -> tuple[int, ...]:
    if isinstance(v, str):
        v = [x for x in v.split(",") if x.strip()]
    return tuple(map(int, v if hasattr(v, "__iter__") else (v,)))


_KINDS = {"int": int, "float": float, "str": str, "bool": _bool, "ints": _ints}


def value(config: dict, kind: str, default, *paths: str):
    """The value at the first path that is there, as its kind."""
    found = next((v for p in paths if (v := config_get(config, p, _ABSENT)) is not _ABSENT), default)
    return None if kind.endswith("?") and found is None else _KINDS[kind.rstrip("?")](found)


def section(config: dict, fields: dict[str, tuple], *places: str) -> dict:
    """Fields by their own paths, or by their names at each of the places."""
    return {n: value(config, kind, default, *(paths or [f"{p}.{n}" for p in places])) for n, (kind, default, *paths) in fields.items()}


def algorithm(config: dict, name: str | None = None) -> str:
    """grpo or ppo."""
    raw = value(config, "str", "grpo", "online.algorithm", "training.algorithm", "algorithm") if name is None else name
    plain = raw.lower().replace("_online", "").replace("_smoke", "")
    if plain not in ("grpo", "ppo"):
        raise ValueError(f"online training runs grpo or ppo, not {raw!r}")
    return plain


def online(config: dict, name: str | None = None) -> dict:
    """All settings of an online run, by section; evaluation is None where it isn't configured or is switched off."""
    critic = algorithm(config, name) == "ppo"
    get = lambda *a: value(config, *a)
    group = get("int", 4, "rollout.group_size", "generation.group_size")
    strategy = get("str?", None, "self_debug.revision_strategy")
    if strategy is None:
        strategy = "rule_based" if get("bool", True, "self_debug.use_rule_based_repair", "agent.use_rule_based_repair") else "none"
    loss = section(config, {k: v for k, v in {**LOSS, **(CRITIC_LOSS if critic else {})}.items() if k != "max_log_ratio"}, "training.loss", "loss", "training")
    evaluated = config_get(config, "evaluation", _ABSENT) is not _ABSENT and get("bool", True, "evaluation.enabled")
    return {
        "algorithm": "ppo" if critic else "grpo",
        "cycles": get("int", 1, "online.cycles", "training.cycles"),
        "seed": get("int", 20260601, "cycle.seed", "experiment.seed"),
        "rollout_mode": get("str", "direct", "cycle.rollout_mode", "rollout.mode"),
        "include_hidden": get("bool", True, "cycle.include_hidden", "execution.include_hidden"),
        "seed_stride": get("int", 1, "online.seed_stride", "training.seed_stride"),
        **{f"sync_old_{m}_before_cycle": get("bool", True, f"online.sync_old_{m}_before_cycle", f"training.sync_old_{m}_before_cycle") for m in (("policy", "value") if critic else ("policy",))},
        "rollout": {"group_size": group, "samples_per_task": get("int", group, "rollout.samples_per_task", "generation.samples_per_task"), **section(config, ROLLOUT)},
        "self_debug": {"revision_strategy": strategy, **section(config, REVISION, "self_debug", "agent")},
        "batch": section(config, {**BATCH, **({} if critic else {"min_reward_std": ("float", 1e-8)})}, "batch"),
        "optimizer": section(config, OPTIMIZER, "training.optimizer", "optimizer", "training"),
        "loss": {**loss, **section(config, {"max_log_ratio": LOSS["max_log_ratio"]}, "training.loss", "loss")},
        "training": {**section(config, TRAINING, "training"), "dtype": get("str", "fp32", "training.dtype", "model.dtype")},
        "evaluation": {**section(config, EVALUATION, "evaluation"), "max_new_tokens": get("int?", None, "evaluation.max_new_tokens", "evaluation.max_response_tokens")} if evaluated else None,
    }
