"""Methods, their typed parameters, and the run configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Param:
    name: str
    sql_type: str
    default: str | None
    effective: bool = True


# The parameters of every method in catalogue order, as name:type=default.
# A leading ~ marks a parameter that is recorded but has no effect.
SCHEMAS = {
    "umap": "n_neighbors:int=10 min_dist:double=0.1 spread:double=1.0 set_op_mix_ratio:double=1.0 "
            "local_connectivity:double=1.0 n_components:int=2 metric:string=euclidean random_state:int=42",
    "tsne": "perplexity:double=25 n_components:int=2 random_state:int=42 learning_rate:double=200.0 n_iter:int=500 "
            "early_exaggeration:double=12.0 ~n_iter_without_progress:int=300 ~min_grad_norm:double=1e-7 "
            "metric:string=euclidean early_exaggeration_iter:int=250 theta:double=0.5 "
            "negative_gradient_method:string=fft initialization:string=pca n_jobs:int=1",
    "isomap": "n_neighbors:int=5 n_components:int=2",
    "lle": "n_neighbors:int=15 n_components:int=2 random_state:int=42",
    "spectral": "n_neighbors:int=10 n_components:int=2 random_state:int=42",
    "mds": "n_components:int=2 random_state:int=42",
    "sammon_random": "n_dims:int=2 n_iter:int=500 tol:double=1e-9 input_type:string=vector random_state:int=42",
    "pca": "n_components:int=2 random_state:int=42",
    "ipca": "n_components:int=2 batch_size:int=200 ~random_state:int=42",
    "svd": "n_components:int=2 random_state:int=42",
    "fa": "n_components:int=2 random_state:int=42",
    "ica": "n_components:int=2 max_iter:int=500 random_state:int=42",
    "agg": "n_clusters:int=2",
    "kpca": "n_components:int=2 kernel:string=rbf gamma:double=1.0 ~fit_inverse_transform:boolean=true random_state:int=42",
    "nystroem_pca": "n_components:int=2 nystroem_components:int=200 kernel:string=rbf gamma:double=1.0 random_state:int=42",
    "grp": "n_components:int=2 eps:double random_state:int=42",
    "srp": "n_components:int=2 density:string=auto eps:double random_state:int=42",
    "nmf": "n_components:int=2 init:string=nndsvda random_state:int=42",
    "dictlearn": "n_components:int=2 random_state:int=42",
    "phate": "n_components:int=2 knn:int=5 decay:double=40 t:string=auto gamma:double=1 random_state:int=42",
    "trimap": "n_dims:int=2 n_inliers:int=12 n_outliers:int=4 n_random:int=3 distance:string=euclidean "
              "weight_temp:double=0.5 lr:double=0.1 n_iters:int=400 random_state:int=42 opt_method:string=dbd "
              "apply_pca:boolean=true",
    "spacemap": "n_components:int=2 n_near_field:int=21 n_middle_field:int=50 d_local:double=0 d_global:double=4.5 "
                "eta:double=0.6 n_epochs:int=200 init:string=spectral metric:string=euclidean ~verbose:boolean=true "
                "~plot_results:boolean=false ~num_plots:int=50",
    "glle": "method:string=GLLE k_neighbors:int=10 max_iterations:int=50 n_components:int=2 "
            "~n_generation_of_embedding:int=3 ~verbosity:int=1",
    "paramrepulsor": "n_components:int=2 n_neighbors:int=5 n_epochs:int=300 lr:double=1.0 ~spread:double=1.0 "
                     "~repulsion_strength:double=1.0 apply_pca:boolean=true init:string=pca ~verbose:boolean=false",
    "pacmap": "n_components:int=2 n_neighbors:int=10 MN_ratio:double=0.5 FP_ratio:double=2.0 num_iters:int=450 "
              "lr:double=1.0 apply_pca:boolean=true init:string=pca random_state:int=42 ~verbose:boolean=false "
              "preprocess_pca:int=50 backend:string=exact",
    "clmds": "n_clusters:int=5 max_iter:int=300 ~random_state:int=42",
    "tsne_pso": "n_components:int=2 perplexity:double=30.0 n_particles:int=10 n_iter:int=500 random_state:int=42 "
                "inertia_weight:double=0.7 h:double=1e-20 f:double=1e-21 use_hybrid:boolean=true "
                "learning_rate:double=200.0 init:string=pca metric:string=euclidean early_exaggeration:double=12.0 "
                "~min_grad_norm:double=1e-7 ~parameter_optimization:boolean=true "
                "~dynamic_weight_adaptation:boolean=true ~small_dataset_handling:boolean=true "
                "~numerical_robustness:boolean=true",
    "slisemap": "radius:double=3.5 lasso:double=0.01 use_slipmap:boolean=false y:string",
    "tsimcne": "n_components:int=2 total_epochs:string=500,50,250 random_state:int=42",
}

# Options that are no catalogue columns: work limits, landmark counts and neighbour backends.
OPTIONS = {
    **dict.fromkeys(("pca", "svd", "fa", "ica"), "solver:string=auto"),
    "dictlearn": "alpha:double=1.0",
    "kpca": "landmarks:int=1024",
    "isomap": "landmarks:int=100 backend:string=exact on_disconnected:string=join random_state:int=42",
    "lle": "reg:double=1e-3 backend:string=exact max_iter:int=60 tol:double=1e-4",
    "spectral": "backend:string=exact max_iter:int=60 tol:double=1e-4 on_disconnected:string=join",
    "glle": "reg:double=1e-3 backend:string=exact max_iter:int=60 tol:double=1e-4 random_state:int=42",
    "mds": "landmarks:int=500 n_init:int=4 max_iter:int=300 eps:double=1e-3 metric:boolean=true",
    "sammon_random": "landmarks:int=500",
    "clmds": "landmarks:int=200 anchors:int=6 candidates:int=256",
    "phate": "landmarks:int=100 backend:string=exact",
    "umap": "n_epochs:int=200 negatives:int=5 learning_rate:double=1.0 init:string=spectral backend:string=exact",
    "tsne": "backend:string=exact",
    "tsne_pso": "cognitive_weight:double=1.0 social_weight:double=1.0 early_exaggeration_iter:int=250 backend:string=exact",
    "trimap": "backend:string=exact init:string=pca",
    "spacemap": "backend:string=exact random_state:int=42",
    "paramrepulsor": "hidden:int=100 backend:string=exact MN_ratio:double=0.5 FP_ratio:double=2.0 random_state:int=42",
    "slisemap": "prototypes:int=25 max_iter:int=10 random_state:int=42",
    "pacmap": "",
}

#: Options of the approximate neighbour joins, for every method with a ``backend``; a backend refuses those of another.
NEIGHBOUR_OPTIONS = "cells:int probes:int trees:int leaf:int rounds:int width:int sample:int delta:double"

METHODS: dict[str, Callable] = {}
_EXTRA: dict[str, list[Param]] = {}


def _parse(text: str) -> list[Param]:
    out = []
    for item in text.split():
        head, _, default = item.partition("=")
        name, _, kind = head.partition(":")
        out.append(Param(name.lstrip("~"), kind, default or None, not name.startswith("~")))
    return out


def method_names() -> list[str]:
    return [*SCHEMAS, *[m for m in _EXTRA if m not in SCHEMAS]]


def schema_of(method: str) -> list[Param]:
    if method in _EXTRA:
        return _EXTRA[method]
    if method not in SCHEMAS:
        raise ValueError(f"unknown method {method!r}")
    return _parse(SCHEMAS[method])


def options_of(name: str) -> list[Param]:
    own = _parse(OPTIONS.get(name, ""))
    joins = any(p.name == "backend" for p in [*own, *schema_of(name)])
    return own + (_parse(NEIGHBOUR_OPTIONS) if joins else [])


def neighbour_options(params: dict[str, Any]) -> dict[str, Any]:
    """The options of the neighbour join among the parameters of a method."""
    return {p.name: params.get(p.name) for p in _parse(NEIGHBOUR_OPTIONS) if params.get(p.name) is not None}


def method(name: str, schema: str | None = None):
    """Register ``fn(df, params) -> DataFrame(item_id, group_key, x, y)`` under a name.

    A new method brings its parameters as text like ``n:int=3 rate:double=0.1``.
    """

    def register(fn):
        if schema is not None:
            _EXTRA[name] = _parse(schema)
        schema_of(name)
        METHODS[name] = fn
        return fn

    return register


_CASTS = {
    "int": lambda v: int(float(v)),
    "double": float,
    "string": str,
    "boolean": lambda v: v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1", "yes"),
}


def typed_params(name: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults overridden by the given values, each cast to its declared type."""
    given = dict(given or {})
    out: dict[str, Any] = {}
    for p in [*schema_of(name), *options_of(name)]:
        value = given.pop(p.name, p.default)
        if isinstance(value, (list, tuple)):
            value = ",".join(str(v) for v in value)
        out[p.name] = None if value is None else _CASTS[p.sql_type](value)
    if given:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(given))}")
    return out


def text_params(params: dict[str, Any]) -> dict[str, str | None]:
    """Parameter values as the catalogue stores them."""
    def text(v):
        if v is None:
            return None
        return str(v).lower() if isinstance(v, bool) else str(v)

    return {k: text(v) for k, v in params.items()}


@dataclass
class RunConfig:
    method: str
    name: str = "default"
    params: dict[str, Any] = field(default_factory=dict)
    subset_strategy: str = "artist_first5"
    subset_size: int = 250


def configs_from(document: dict[str, list[dict[str, Any]]]) -> list[RunConfig]:
    """Run configurations from a parsed method -> list-of-settings document."""
    out = []
    for name, entries in document.items():
        for entry in entries:
            rest = dict(entry)
            out.append(RunConfig(
                name, rest.pop("name", "default"),
                subset_strategy=rest.pop("subset_strategy", "artist_first5"),
                subset_size=int(rest.pop("subset_size", 250)), params=rest,
            ))
    return out


def run_method(df, name: str, **given):
    """Coordinates item_id, group_key, x, y of ``df`` under a registered method."""
    import planisphere.methods  # noqa: F401

    if name not in METHODS:
        schema_of(name)
        raise NotImplementedError(f"{name} is recorded in the catalogue but not supported")
    return METHODS[name](df, typed_params(name, given))
