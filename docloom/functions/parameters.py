"""Training parameters by the kind of a model, and where files are looked for."""

from __future__ import annotations

from collections.abc import Callable

# ---- fixed values: parameters of the domain's models; a name that holds the key takes them, any other the defaults ----
DEFAULTS = {
    "max_length": 256, "batch_size": 32, "accumulation_steps": 4, "epochs": 7, "learning_rate": 8e-6, "warmup_ratio": 0.05, "train_val_split": 0.15,
    "weight_decay": 0.015, "dropout_rate": 0.25, "fixed_gamma": 2.0, "augmentation_rate": 0.3, "class_weight_enabled": True, "recall_focus": True,
}
BY_MODEL = (
    ("roberta", {"batch_size": 24, "epochs": 6, "learning_rate": 5e-6, "warmup_ratio": 0.1, "weight_decay": 0.01, "dropout_rate": 0.2}),
    ("deberta", {"batch_size": 16, "accumulation_steps": 8, "epochs": 5, "learning_rate": 3e-6, "warmup_ratio": 0.1, "weight_decay": 0.02, "dropout_rate": 0.15, "fixed_gamma": 1.5}),
)


def training_parameters(model: str) -> dict:
    """The parameters for a model by its name, case aside."""
    name = model.lower()
    return DEFAULTS | next((given for key, given in BY_MODEL if key in name), {})


def resolved(path: str, folders: tuple[str, ...], exists: Callable[[str], bool]) -> str:
    """The path in the first folder that has it, else the path as it is."""
    return next((p for f in folders if exists(p := f"{f.rstrip('/')}/{path}")), path)
