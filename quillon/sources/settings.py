"""Run settings: read from YAML over defaults, checked, and compared before a run is resumed. All on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    arch: str = "convnext_base"
    loss: str = "bce"
    precision: str = "bf16"
    image_size: int = 384
    batch_size: int = 32
    epochs: int = 30
    lr: float = 1e-4
    weight_decay: float = 0.05
    warmup_frac: float = 0.1
    max_fpr: float = 0.15
    flip_p: float = 0.5
    blur_p: float = 0.0
    noise_p: float = 0.0
    gamma_min: float = 0.8
    gamma_max: float = 1.25
    quality_min: int = 30
    quality_max: int = 100
    magnitude_scale: float = 1.0


#: What the named settings may be.
CHOICES = {"loss": ("bce", "pauc"), "precision": ("fp32", "fp16", "bf16")}
#: Settings that must not change when a run goes on.
HELD = ("arch", "loss", "precision", "image_size", "batch_size", "epochs", "lr", "weight_decay", "warmup_frac", "max_fpr", "flip_p", "blur_p", "noise_p", "gamma_min", "gamma_max", "quality_min", "quality_max")


def read_settings(spark: SparkSession, path: str) -> Settings:
    """A flat YAML file over the defaults; an empty file gives the defaults, an unknown key is an error."""
    import yaml

    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    given = yaml.safe_load(text) or {}
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Settings(), **given)


def violations(s: Settings) -> list[str]:
    """What is wrong with the settings, in the order of the fields."""
    values, out = asdict(s), []
    for name, value in values.items():
        if name in CHOICES and value not in CHOICES[name]:
            out.append(f"{name} must be one of {', '.join(CHOICES[name])}")
        if name.endswith(("_p", "_frac")) and not 0 <= value <= 1:
            out.append(f"{name} must lie in [0, 1]")
        if name in ("image_size", "batch_size", "epochs", "lr") and value <= 0:
            out.append(f"{name} must be above 0")
        if name in ("weight_decay", "magnitude_scale") and value < 0:
            out.append(f"{name} must not be negative")
        if name == "max_fpr" and not 0 < value <= 1:
            out.append("max_fpr must lie in (0, 1]")
        if name.endswith("_min") and value > values[name[:-4] + "_max"]:
            out.append(f"{name} must not exceed {name[:-4]}_max")
    return out


def check(s: Settings) -> Settings:
    bad = violations(s)
    if bad:
        raise ValueError("; ".join(bad))
    return s


def mismatches(saved: dict, current: dict) -> list[str]:
    """Held settings that differ (or that only one side has)."""
    return [n for n in HELD if saved.get(n) != current.get(n)]


def check_resumable(saved: dict, current: dict) -> None:
    bad = mismatches(saved, current)
    if bad:
        raise ValueError(f"a run can't go on with other settings: {', '.join(bad)}")
