"""The trackers and what is known of them: a table, presets, strategies by name, and plugins from outside."""

from __future__ import annotations

import importlib
import importlib.metadata
import importlib.util
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from skein.engines import tracking as engine
from skein.operators import linkage, tracking, windows


class SequencePlugin(Protocol):
    """Images or targets in, points out."""

    def do_sequence(self, rows: DataFrame, **parameters) -> DataFrame: ...


class TrackingPlugin(Protocol):
    """Points (frame, id, x, y, z) in, edges (frame, i, step, k) out."""

    def do_tracking(self, points: DataFrame, **parameters) -> DataFrame: ...


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    default: str
    help: str


@dataclass(frozen=True)
class Tracker:
    """What a tracker can do; rankings as words."""

    name: str
    title: str
    backward: bool = False
    new_particles: bool = False
    images: bool = False
    postprocess: bool = False
    gaps: bool = False
    speed: str = "fast"
    density: str = "moderate"
    accuracy: str = "standard"
    parameters: tuple[Parameter, ...] = ()


_BOX = Parameter("half", "float", "2.0", "half the search box, an axis, in units a frame")
_ACC = Parameter("dacc", "float", "0", "largest acceleration of a link; 0: no limit")
_V = Parameter("v_max", "float", "10.0", "search radius of a track of one point")

# Names, abilities and rankings of the trackers, which the recommendation scores.
TRACKERS = (
    Tracker("full_multipass", "Forward, backward and post-processing", True, True, True, True, True, "moderate", "low_to_moderate", "highest", (_BOX, _ACC)),
    Tracker("priority_segment_3d", "Three-level cascade in space", speed="fastest", density="low_to_moderate", accuracy="high", parameters=(_BOX, _ACC)),
    Tracker("4be", "Best estimate over four frames", speed="fastest", density="low_to_moderate", parameters=(_BOX,)),
    Tracker("standard_forward", "Forward pass in images and space", new_particles=True, images=True, parameters=(_BOX, _ACC)),
    Tracker("two_directional", "Forward and backward", True, True, True, speed="moderate", parameters=(_BOX, _ACC)),
    Tracker("splitter_tracking", "Four views of one sensor", new_particles=True, images=True),
    Tracker("hybrid_deltat_3d", "Coarse frames first, then those between", new_particles=True, gaps=True, speed="moderate", density="low_to_moderate", accuracy="high", parameters=(_V, Parameter("stride", "int", "5", "frames between coarse ones"))),
    Tracker("two_phase", "Search in space, choice in images", new_particles=True, images=True, gaps=True, parameters=(_V, Parameter("max_gap", "int", "2", "frames a track may bridge"))),
    Tracker("holistic", "Two-phase with rounds of blob refinement", new_particles=True, images=True, gaps=True, speed="slow", accuracy="high", parameters=(_V,)),
    Tracker("unified", "Chooses among the others by the data", True, True, True, True, True, accuracy="highest", parameters=(_BOX, _ACC)),
)


def trackers(spark: SparkSession) -> DataFrame:
    """A row a tracker, its parameters as an array of structs."""
    fields = "name string, title string, backward boolean, new_particles boolean, images boolean, postprocess boolean, gaps boolean, speed string, density string, accuracy string, parameters array<struct<name:string,type:string,default:string,help:string>>"
    return spark.createDataFrame([tuple(asdict(t)[k] if k != "parameters" else [tuple(asdict(p).values()) for p in t.parameters] for k in asdict(t)) for t in TRACKERS], fields)


def tracker(name: str) -> Tracker | None:
    return next((t for t in TRACKERS if t.name == name), None)


def tracker_text() -> str:
    """The trackers as lines of text."""
    return "\n".join(f"{t.name:22} {t.speed:9} {t.density:16} {t.accuracy:9} {t.title}" for t in TRACKERS)


# What each preset sets.
PRESETS = {
    "priority_segment_3d": {"track_mode": 1, "flagNewParticles": False, "postprocess": True},
    "fast": {"track_mode": 1, "flagNewParticles": False, "postprocess": True},
    "fast_3d": {"track_mode": 1, "flagNewParticles": False, "postprocess": True},
    "full_multipass": {"track_mode": 0, "flagNewParticles": True, "postprocess": True},
    "two_directional": {"track_mode": 0, "flagNewParticles": True, "postprocess": False},
    "standard_forward": {"track_mode": 0, "flagNewParticles": True, "postprocess": False},
    "unified": {"track_mode": 1, "flagNewParticles": True, "postprocess": True},
}


def apply_preset(name: str, track: dict, plugins: dict | None = None, custom: str | None = None) -> tuple[dict, dict]:
    """Track and plugin parameters with a preset's choices; search bounds stay. A custom plugin keeps what is selected unless it is named."""
    track, plugins = dict(track), dict(plugins or {})
    track |= PRESETS.get(name, {})
    if name == "custom_plugin":
        plugins["selected_tracking"] = custom or plugins.get("selected_tracking", "default")
    else:
        plugins["selected_tracking"] = name
    track["preset"] = plugins["selected_tracking"]
    return track, plugins


# --- strategies ------------------------------------------------------------------------------------------------------------------------


def cascade_3d(points: DataFrame, half=2.0, frames: int | None = None, **more) -> DataFrame:
    return windows.cascade(points, half, frames=frames or windows.FRAMES, **more)


def four_be(points: DataFrame, half=2.0, frames: int | None = None, **more) -> DataFrame:
    return windows.four_be(points, half, frames=frames or windows.FRAMES, **more)


def two_directional(points: DataFrame, half=2.0, dacc: float = 1.0, angle: float = 0.0, frames: int | None = None) -> DataFrame:
    return windows.two_directional(points, half, dacc, angle, frames or windows.FRAMES)


def nearest_assignment(points: DataFrame, frames: int | None = None, **more) -> DataFrame:
    return windows.nearest_assignment(points, frames or windows.FRAMES, **more)


def hybrid(points: DataFrame, frames: int | None = None, **more) -> DataFrame:
    return windows.hybrid(points, frames=frames or windows.FRAMES, **more)


def two_phase(points: DataFrame, frames: int | None = None, **more) -> DataFrame:
    return windows.two_phase(points, engine.TwoPhase(**more), frames or windows.FRAMES)


def full_multipass(points: DataFrame, half=2.0, dacc: float = 1.0, max_gap: int = 2, frames: int | None = None) -> DataFrame:
    """Forward and backward, then links that both ends keep, the first frame seeded backwards, and gaps bridged."""
    rows = tracking.linkage_of(points, two_directional(points, half, dacc, frames=frames))
    return postprocessed(rows, dacc, max_gap, half if isinstance(half, float) else max(half))


def postprocessed(rows: DataFrame, dacc: float, max_gap: int = 2, dv_max: float = 2.0) -> DataFrame:
    """Edges of a linkage after reciprocity, cold start and gaps."""
    rows = linkage.enforce_reciprocity(rows)
    rows = linkage.with_edges(rows, linkage.seed_cold_start(rows, dv_max))
    rows = linkage.with_edges(rows, linkage.relink_gaps(rows, max_gap, dacc))
    return linkage.links(rows)


def unified(points: DataFrame, v_max: float = 5.0, frames: int | None = None, **more) -> DataFrame:
    """Two-phase tracking both ways where a frame is sparse for its motion, the cascade where it is dense; then reciprocity and gaps."""
    from pyspark.sql import functions as F

    from skein.operators import spatial

    scale = spatial.motion_scale(points, v_max).agg(F.avg("ratio").alias("r")).first()["r"]
    found = two_phase(points, frames, v_max=v_max, bidirectional=True) if scale is None or scale < 0.6 else cascade_3d(points, v_max, frames)
    return postprocessed(tracking.linkage_of(points, found), v_max, 2, v_max)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "priority_segment_3d": cascade_3d, "4be": four_be, "two_directional": two_directional, "standard_forward": cascade_3d, "full_multipass": full_multipass,
    "nearest_assignment": nearest_assignment, "hybrid_deltat_3d": hybrid, "two_phase": two_phase, "holistic": two_phase, "unified": unified,
}
# Other names of the strategies.
ALIASES = {
    "default": "priority_segment_3d", "fast": "priority_segment_3d", "fast_3d": "priority_segment_3d", "cython_3d": "priority_segment_3d", "cython_3d_tracking": "priority_segment_3d",
    "four_be": "4be", "four_be_tracking": "4be", "multi_deltat_3d": "hybrid_deltat_3d", "unified_tracking": "unified", "two_phase_tracking": "two_phase",
}


def resolve(name: str, folder: str | None = None, group: str = "skein.trackers") -> Callable[..., DataFrame]:
    """A strategy by name: built in, then of installed entry points, then a module in a folder whose Tracking has do_tracking or which has do_tracking itself."""
    name = ALIASES.get(name, name)
    if name in STRATEGIES:
        return STRATEGIES[name]
    for point in importlib.metadata.entry_points(group=group):
        if point.name == name:
            return _callable(point.load())
    path = Path(folder or ".") / f"{name}.py"
    if not path.exists():
        raise ModuleNotFoundError(f"no tracker {name}")
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return _callable(module)


def _callable(found) -> Callable[..., DataFrame]:
    if hasattr(found, "Tracking"):
        found = found.Tracking()
    return getattr(found, "do_tracking", found)


# --- sources of calibration --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CalibrationSource:
    name: str
    title: str
    needs: str
    gives: str


SOURCES = (
    CalibrationSource("points", "Known points and their pixels", "six points or more in a camera", "orientation, interior and lens"),
    CalibrationSource("linear", "Direct linear transformation", "six points that aren't in a plane", "a first orientation without lens"),
    CalibrationSource("look_at", "Place and target of a camera", "measured places", "a first orientation"),
    CalibrationSource("pinhole", "A pinhole model of another library", "its matrix, distortion, rotation and translation", "all of the camera in air"),
    CalibrationSource("tracers", "Points of a run itself", "matched points and good first orientations", "refined orientations"),
)


def sources() -> list[str]:
    return [s.name for s in SOURCES]


def source(name: str) -> CalibrationSource:
    found = next((s for s in SOURCES if s.name == name), None)
    if found is None:
        raise KeyError(f"no calibration source {name}")
    return found
