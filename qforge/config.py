"""Forecast configuration (§1.3, §1.5: S14, I11-I15, T-10, T-12).

A plain dataclass on the driver; the JSON layout follows the reference's
config document (mappings, feature_engineering, location_settings, model).
Unlike the reference, ordinal mappings and ``date_col`` are kept (T4).
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

# Fixed values that must equal the reference's defaults.
DEFAULT_QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
DEFAULT_TRAINING = {"objective": "reg:quantileerror", "tree_method": "hist", "verbosity": 0}
DEFAULT_CV = {"num_boost_round": 100, "nfold": 5, "early_stopping_rounds": 10, "verbose_eval": False}
DEFAULT_MAX_DISTANCE_KM = 50.0
# The agent-proposed defaults differ from the heuristic ones
AGENT_HYPERPARAMETERS = {
    "training": {"objective": "reg:quantileerror", "tree_method": "hist", "max_depth": 6,
                 "eta": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "verbosity": 0},
    "cv": {"num_boost_round": 200, "nfold": 5, "early_stopping_rounds": 20, "verbose_eval": False},
}
# Optional encodings and the column kinds they apply to
LOCATION_ENCODINGS = ("cost_of_living", "metro_population")
DATE_ENCODINGS = ("normalize_recent", "least_recent", "weight_recent")
OPTIONAL_ENCODINGS = LOCATION_ENCODINGS + DATE_ENCODINGS


class ConfigError(ValueError):
    pass


@dataclass
class FeatureSpec:
    name: str
    monotone_constraint: int = 0

    def __post_init__(self):
        if self.monotone_constraint not in (-1, 0, 1):
            raise ConfigError(f"monotone_constraint of {self.name} must be -1, 0 or 1")


@dataclass
class ForecastConfig:
    targets: list[str]
    features: list[FeatureSpec]
    quantiles: list[float] = field(default_factory=lambda: list(DEFAULT_QUANTILES))
    sample_weight_k: float = 1.0
    date_col: str | None = "Date"
    ref_date: str | None = None
    mappings: dict = field(default_factory=lambda: {"levels": {}, "location_targets": {}})
    ranked_cols: dict = field(default_factory=dict)          # column -> mapping key
    proximity_cols: list = field(default_factory=list)
    optional_encodings: dict = field(default_factory=dict)   # column -> {"type": ..., "params": {}}
    max_distance_km: float = DEFAULT_MAX_DISTANCE_KM
    location_settings: dict = field(default_factory=dict)
    training: dict = field(default_factory=lambda: dict(DEFAULT_TRAINING))
    cv: dict = field(default_factory=lambda: dict(DEFAULT_CV))

    def __post_init__(self):
        validate(self)

    # -- naming (T-10) --------------------------------------------------------
    @staticmethod
    def model_name(target: str, q: float) -> str:
        return f"{target}_p{int(q * 100)}"

    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]

    def constraints(self) -> list[int]:
        return [f.monotone_constraint for f in self.features]

    def mapping(self, key: str) -> dict:
        if key in self.mappings:
            return self.mappings[key]
        raise ConfigError(f"mapping '{key}' not found in config mappings")

    # -- JSON layout ----------------------------------------------------------
    def to_dict(self) -> dict:
        return {
            "mappings": copy.deepcopy(self.mappings),
            "feature_engineering": {"ranked_cols": dict(self.ranked_cols),
                                    "proximity_cols": list(self.proximity_cols),
                                    "optional_encodings": copy.deepcopy(self.optional_encodings)},
            "location_settings": {"max_distance_km": self.max_distance_km, **self.location_settings},
            "model": {"targets": list(self.targets), "quantiles": list(self.quantiles),
                      "sample_weight_k": self.sample_weight_k, "date_col": self.date_col,
                      "ref_date": self.ref_date,
                      "features": [{"name": f.name, "monotone_constraint": f.monotone_constraint}
                                   for f in self.features],
                      "hyperparameters": {"training": dict(self.training), "cv": dict(self.cv)}},
        }

    @classmethod
    def from_dict(cls, d: dict | None) -> "ForecastConfig":
        if not d:
            raise ConfigError("config must not be empty")
        model = d.get("model") or {}
        fe = d.get("feature_engineering") or {}
        mappings = dict(d.get("mappings") or {"levels": {}, "location_targets": {}})
        ranked = dict(fe.get("ranked_cols") or {})
        prox = list(fe.get("proximity_cols") or [])
        if not fe and mappings.get("levels"):
            # legacy layout: Level ranked by levels, Location by proximity
            ranked = {"Level": "levels"}
            prox = ["Location"] if mappings.get("location_targets") else []
        hp = model.get("hyperparameters") or {}
        loc = dict(d.get("location_settings") or {})
        return cls(
            targets=list(model.get("targets") or []),
            features=[FeatureSpec(f["name"], int(f.get("monotone_constraint", 0)))
                      for f in (model.get("features") or [])],
            quantiles=list(model.get("quantiles") or DEFAULT_QUANTILES),
            sample_weight_k=float(model.get("sample_weight_k", 1.0)),
            date_col=model.get("date_col", "Date"),
            ref_date=model.get("ref_date"),
            mappings=mappings, ranked_cols=ranked, proximity_cols=prox,
            optional_encodings=dict(fe.get("optional_encodings") or {}),
            max_distance_km=float(loc.pop("max_distance_km", DEFAULT_MAX_DISTANCE_KM)),
            location_settings=loc,
            training=dict(hp.get("training") or DEFAULT_TRAINING),
            cv=dict(hp.get("cv") or DEFAULT_CV))


def validate(cfg: ForecastConfig) -> None:
    """The reference's schema rules, plus label collisions."""
    if not cfg.targets:
        raise ConfigError("at least one target is required")
    if not cfg.quantiles:
        raise ConfigError("at least one quantile is required")
    labels = {}
    for q in cfg.quantiles:
        if not isinstance(q, (int, float)) or not 0.0 <= float(q) <= 1.0:
            raise ConfigError(f"quantile {q} must be within [0, 1]")
        lbl = int(float(q) * 100)
        if lbl in labels and labels[lbl] != q:
            raise ConfigError(f"quantiles {labels[lbl]} and {q} share the model label p{lbl}")
        labels[lbl] = q
    names = [f.name for f in cfg.features]
    if len(names) != len(set(names)):
        raise ConfigError("feature names must be unique")
    if cfg.sample_weight_k < 0:
        raise ConfigError("sample_weight_k must be >= 0")
    if cfg.max_distance_km < 0:
        raise ConfigError("max_distance_km must be >= 0")
    for col, key in cfg.ranked_cols.items():
        if not isinstance(key, dict) and key not in cfg.mappings:
            raise ConfigError(f"ranked column {col} refers to missing mapping '{key}'")


def check_optional_encodings(cfg: ForecastConfig, column_types: dict[str, str]) -> list[str]:
    """Location encodings only on location columns, date ones only on datetime."""
    errors = []
    for col, enc in cfg.optional_encodings.items():
        kind = enc.get("type") if isinstance(enc, dict) else enc
        ctype = column_types.get(col)
        if kind in LOCATION_ENCODINGS and ctype != "location":
            errors.append(f"{kind} needs a location column, {col} is {ctype}")
        elif kind in DATE_ENCODINGS and ctype != "datetime":
            errors.append(f"{kind} needs a datetime column, {col} is {ctype}")
        elif kind not in OPTIONAL_ENCODINGS:
            errors.append(f"unknown optional encoding {kind} on {col}")
    return errors


def default_hyperparameters() -> dict:
    """I15."""
    return copy.deepcopy(AGENT_HYPERPARAMETERS)


def assemble_config(roles: dict, encodings: dict, model_cfg: dict | None = None) -> ForecastConfig:
    """Roles + encodings (+ model settings) -> config.

    ``roles = {"targets": [...], "features": [...], "locations": [...]}``;
    ``encodings[col] = {"type": "numeric"|"ordinal"|"proximity"|...,
    "mapping": {...}, "optional": {...}}``.  Ordinal columns keep their
    mapping under ``{col.lower()}_mapping``; every encoded column enters the
    feature list under its encoded name (T20).
    """
    model_cfg = model_cfg or {}
    mappings = {"levels": {}, "location_targets": dict(model_cfg.get("location_targets") or {})}
    ranked, prox, optional = {}, [], {}
    constraints = dict(model_cfg.get("constraints") or {})
    feats = []
    for col in roles.get("features", []):
        enc = encodings.get(col, {"type": "numeric"})
        kind = enc.get("type", "numeric")
        if kind == "ordinal" and enc.get("mapping"):
            key = f"{col.lower()}_mapping"
            mappings[key] = dict(enc["mapping"])
            ranked[col] = key
            feats.append(FeatureSpec(f"{col}_Enc", constraints.get(col, 1)))
        elif kind == "proximity":
            prox.append(col)
            feats.append(FeatureSpec(f"{col}_Enc", constraints.get(col, 0)))
        else:
            feats.append(FeatureSpec(col, constraints.get(col, 0)))
        if enc.get("optional"):
            optional[col] = dict(enc["optional"])
    for loc in roles.get("locations", []):
        if loc not in prox:
            prox.append(loc)
            if f"{loc}_Enc" not in [f.name for f in feats]:
                feats.append(FeatureSpec(f"{loc}_Enc", 0))
    hp = model_cfg.get("hyperparameters") or {}
    return ForecastConfig(
        targets=list(roles.get("targets", [])), features=feats,
        quantiles=list(model_cfg.get("quantiles") or DEFAULT_QUANTILES),
        sample_weight_k=float(model_cfg.get("sample_weight_k", 1.0)),
        date_col=model_cfg.get("date_col", "Date"), ref_date=model_cfg.get("ref_date"),
        mappings=mappings, ranked_cols=ranked, proximity_cols=prox, optional_encodings=optional,
        training=dict(hp.get("training") or DEFAULT_TRAINING), cv=dict(hp.get("cv") or DEFAULT_CV))


def finalize_config(cfg: ForecastConfig, overrides: dict) -> ForecastConfig:
    """Overwrite features, quantiles, hyperparameters, location settings."""
    d = cfg.to_dict()
    if "features" in overrides:
        d["model"]["features"] = overrides["features"]
    if "quantiles" in overrides:
        d["model"]["quantiles"] = overrides["quantiles"]
    if "hyperparameters" in overrides:
        d["model"]["hyperparameters"].update(overrides["hyperparameters"])
    if "location_settings" in overrides:
        d["location_settings"].update(overrides["location_settings"])
    return ForecastConfig.from_dict(d)


def save_config(cfg: ForecastConfig, path: str) -> None:
    """Indented JSON (driver-side file)."""
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(cfg.to_dict(), fh, indent=2)


def load_config(path: str) -> ForecastConfig:
    with open(path, encoding="utf-8") as fh:
        return ForecastConfig.from_dict(json.load(fh))
