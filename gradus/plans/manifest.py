"""What it takes to run an experiment again: files with checksums, models, checkpoints, the machine.

All of it is about a folder of sources and small files, and runs on the driver; checksums of data
are records.artifacts, a Spark job.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import io
import json
import os
import platform
import re
import subprocess
import sys
import tarfile
from datetime import datetime, timezone
from pathlib import Path

from gradus.sources.records import config_get, glob_pattern, load_config

# Globs of the files that a manifest holds, those it leaves out, and its groups.
INCLUDE = (".gitignore", "LICENSE", "README.md", "methodology.md", "pyproject.toml", "configs/**", "docker/**", "docs/**", "scripts/*.py", "src/**/*.py", "tests/**/*.py")
CACHES = (".git/**", "**/__pycache__/**", "**/*.pyc", ".mypy_cache/**", ".pytest_cache/**", ".ruff_cache/**", ".venv/**", "venv/**")
EXCLUDE = (*CACHES, "blog/**", "data/raw/**", "data/processed/**", "data/splits/**", "outputs/checkpoints/**", "outputs/evals/**", "outputs/figures/**", "outputs/rollouts/**", "outputs/reports/*", "plan.md", "progress.md")
GROUPS = {
    "config_artifacts": ("configs/**/*.json", "configs/**/*.jsonl", "configs/**/*.yaml", "configs/**/*.yml"),
    "dataset_artifacts": ("configs/datasets/**", "data/splits/**"),
    "environment_artifacts": ("pyproject.toml", "requirements*.txt", "requirements/**/*.txt", "uv.lock", "poetry.lock", "pdm.lock", "conda*.yml", "environment*.yml", "docker/**"),
    "checkpoint_manifests": ("outputs/checkpoints/**/checkpoint*.json", "outputs/checkpoints/**/checkpoint_manifest.json", "artifacts/**/checkpoint*.json"),
}
LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy", "torch", "transformers", "peft", "accelerate", "trl")
#: Keys by which a block of a model is one that is trained (fixed values).
TRAINED = ("backend", "full_finetune", "use_lora", "value_model", "old_policy", "reference")


def _sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def files(root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> list[dict]:
    """path (below root), bytes and sha256 of files that match include and not exclude, by path."""
    wanted, unwanted = (re.compile("|".join(map(glob_pattern, g)) or r"(?!)") for g in (include, exclude))
    base = Path(root).resolve()
    found = sorted(p for p in base.rglob("*") if p.is_file())
    names = [(p, p.relative_to(base).as_posix()) for p in found]
    return [{"path": n, "bytes": p.stat().st_size, "sha256": _sha256(p)} for p, n in names if wanted.match(n) and not unwanted.match(n)]


def models_of(source: str, config: dict) -> list[dict]:
    """Models and tokenizers that a configuration names, with their role."""
    model, generation = config_get(config, "model"), config_get(config, "generation")
    blocks = []
    if isinstance(model, dict):
        blocks += [("model", "policy" if any(k in model for k in TRAINED) else "model", model), ("model.value_model", "value_model", model.get("value_model"))]
    blocks.append(("generation", "generation", generation))
    out = []
    for at, role, block in blocks:
        if not isinstance(block, dict):
            continue
        name, text = block.get("name") or block.get("model_name_or_path") or block.get("model"), lambda k: None if block.get(k) is None else str(block[k])  # noqa: B023
        if name is not None or block.get("tokenizer") is not None:
            out.append({"source_path": source, "config_path": at, "role": role, "name": str(name or block["tokenizer"]), "tokenizer": text("tokenizer"), "revision": text("revision"), "tokenizer_revision": text("tokenizer_revision")})
    return out


def models(root: str, configs: list[dict]) -> list[dict]:
    """Those of all configurations, one for each place and role; files that can't be read have none."""
    seen = {}
    for c in configs:
        try:
            config = load_config(str(Path(root) / c["path"]))
        except (OSError, ValueError):
            continue
        for m in models_of(c["path"], config):
            seen.setdefault((m["source_path"], m["config_path"], m["role"]), m)
    return list(seen.values())


def checkpoints(root: str, manifests: list[dict]) -> list[dict]:
    """Files that checkpoint manifests list; entries without a path and a sha256 are left out."""
    out = []
    for m in manifests:
        try:
            payload = json.loads((Path(root) / m["path"]).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        listed = payload.get("artifacts") if isinstance(payload, dict) else None
        for a in listed if isinstance(listed, list) else ():
            if isinstance(a, dict) and isinstance(a.get("sha256"), str) and isinstance(a.get("path"), str):
                out.append({"source_path": m["path"], "kind": str(a.get("kind", "artifact")), "path": a["path"], "bytes": a["bytes"] if isinstance(a.get("bytes"), int) else None, "sha256": a["sha256"]})
    return out


def environment() -> dict:
    """The machine, and the versions of libraries that are installed; none is imported."""
    versions = {}
    for name in LIBRARIES:
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            continue
    return {"machine": platform.machine(), "processor": platform.processor() or platform.machine(), "cpu_count": os.cpu_count(), "accelerator": "cpu", "library_versions": versions}


def _git(root: str, *args: str) -> str | None:
    """What git says, or None outside a repository and where there is no git."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=False)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def build(root: str, project: str, version: str = "unknown", commands: tuple[str, ...] = (), notes: tuple[str, ...] = (), at: str | None = None) -> dict:
    groups = {name: files(root, globs, CACHES) for name, globs in GROUPS.items()}
    every = files(root)
    revision, status = _git(root, "rev-parse", "HEAD"), _git(root, "status", "--short")
    return {
        "generated_at_utc": at or datetime.now(timezone.utc).isoformat(timespec="seconds"), "project_name": project, "package_version": version, "python_version": sys.version.split()[0], "platform": platform.platform(), "runtime_environment": environment(),
        "git_revision": (revision or "").strip() or None, "git_status_short": [x for x in (status or "").splitlines() if x.strip()], "artifact_count": len(every), "artifacts": every, **groups,
        "checkpoint_artifacts": checkpoints(root, groups["checkpoint_manifests"]), "model_references": models(root, groups["config_artifacts"]), "commands": list(commands), "notes": list(notes),
    }


def write_json(payload: dict, path: str) -> None:
    """Any manifest, also that of a checkpoint, with sorted keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def markdown(manifest: dict) -> str:
    out = [f"# {manifest['project_name']}: how to run it again", ""]
    out += [f"- {k}: {manifest[k]}" for k in ("generated_at_utc", "package_version", "python_version", "platform", "git_revision", "artifact_count")]
    for name, rows in manifest.items():
        if isinstance(rows, list):
            told = [f"- `{r['path']}` ({r['bytes']} bytes, sha256 `{r['sha256']}`)" if isinstance(r, dict) and "sha256" in r else "- " + (", ".join(f"{k} {v}" for k, v in r.items() if v is not None) if isinstance(r, dict) else r) for r in rows]
            out += ["", f"## {name}", "", *(told or ["- none"])]
    return "\n".join(out) + "\n"


def write_markdown(manifest: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(markdown(manifest), encoding="utf-8")


def archive(manifest: dict, root: str, path: str, folder: str = "reproducibility") -> None:
    """A tar.gz of the manifest and of the files it lists that are still there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    body = json.dumps(manifest, indent=2, sort_keys=True).encode()
    with tarfile.open(path, "w:gz") as out:
        info = tarfile.TarInfo(f"{folder}/manifest.json")
        info.size = len(body)
        out.addfile(info, io.BytesIO(body))
        for f in manifest["artifacts"]:
            if (at := Path(root) / f["path"]).exists():
                out.add(at, arcname=f"{folder}/{f['path']}")
