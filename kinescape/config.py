"""Settings of the measuring routes, checked when made; JSON in and out; identity of a run."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, fields


def _bound(default, kind: type = float, least: float | None = None, over: float | None = None, most: float | None = None, under: float | None = None, odd: bool = False):
    """A number's default and what it must keep to; null is allowed where it is the default."""
    return field(default=default, metadata={"kind": kind, "least": least, "over": over, "most": most, "under": under, "odd": odd})


def _among(default: str, *names: str):
    return field(default=default, metadata={"names": names})


#: Each limit's name, whether a value keeps to it, and how it is told.
_LIMITS = (
    ("least", lambda v, bound: v >= bound, "at least"), ("over", lambda v, bound: v > bound, "over"),
    ("most", lambda v, bound: v <= bound, "at most"), ("under", lambda v, bound: v < bound, "under"),
)


class _Checked:
    """Settings whose fields' metadata tell their bounds; ``rules`` yields what else is wrong."""

    def __post_init__(self):
        wrong = [fault for f in fields(self) for fault in self._faults(f)] or [*self.rules()]
        if wrong:
            raise ValueError("; ".join(wrong))

    def _faults(self, f):
        value, told = getattr(self, f.name), f.metadata
        if "names" in told and value not in told["names"]:
            yield f"{f.name} must be one of {', '.join(told['names'])}"
        if "kind" not in told or value is None and f.default is None:
            return
        kinds = (int,) if told["kind"] is int else (int, float)
        if type(value) not in kinds or not math.isfinite(value):
            yield f"{f.name} must be a {'whole' if told['kind'] is int else 'finite'} number"
            return
        yield from (f"{f.name} must be {word} {told[name]}" for name, kept, word in _LIMITS if told[name] is not None and not kept(value, told[name]))
        if told["odd"] and value % 2 == 0:
            yield f"{f.name} must be odd"

    def rules(self):
        return ()


@dataclass(frozen=True)
class Calibration(_Checked):
    """Micrometres a pixel and seconds a frame; a source is needed where either is known."""

    pixel_um: float | None = _bound(None, over=0)
    frame_s: float | None = _bound(None, over=0)
    source: str | None = None

    def require_source(self) -> None:
        if (self.pixel_um or self.frame_s) and not self.source:
            raise ValueError("a calibrated run must name the source of its calibration")

    @property
    def length_unit(self) -> str:
        return "um" if self.pixel_um else "px"

    @property
    def speed_unit(self) -> str:
        return f"{self.length_unit}/{'s' if self.frame_s else 'frame'}"


@dataclass(frozen=True)
class MaskSettings(_Checked):
    """Thresholding of a frame and the clean-up that follows."""

    method: str = _among("otsu", "otsu", "local", "external")
    factor: float = _bound(0.8, over=0)
    least_pixels: int = _bound(3, int, least=0)
    opening: int = _bound(1, int, least=0)
    border_free: bool = True
    block: int = _bound(31, int, least=3, odd=True)
    offset: float = _bound(0.0)
    background: int = _bound(0, int, least=0)


@dataclass(frozen=True)
class SpotSettings(_Checked):
    """Blob detector of the particle route."""

    sigma: float = _bound(1.5, over=0)
    background_sigma: float = _bound(6.0, over=0)
    snr: float = _bound(3.0, over=0)
    apart: int = _bound(3, int, least=1)
    support: float = _bound(0.2, over=0, under=1)
    radius: float = _bound(4.5, over=0)
    least_pixels: int = _bound(3, int, least=1)

    def rules(self):
        if self.sigma >= self.background_sigma:
            yield "background_sigma must be over sigma"


@dataclass(frozen=True)
class LinkSettings(_Checked):
    """Particle linker: gate, margin, weight of the predicted place, frames a track may miss."""

    gate: float = _bound(6.0, over=0)
    margin: float = _bound(0.5, least=0)
    prediction: float = _bound(0.0, least=0, most=1)
    gap: int = _bound(0, int, least=0, most=2)


def _channels(channels: tuple[int, ...]):
    if not channels or len({*channels}) < len(channels) or any(type(c) is not int or c < 0 for c in channels):
        yield "channels must be different whole numbers"


@dataclass(frozen=True)
class MovieSettings(_Checked):
    """A two-channel run of the baseline route."""

    sample: str = "sample"
    replicate: str | None = None
    channels: tuple[int, int] = (0, 1)
    calibration: Calibration = field(default_factory=Calibration)
    masks: tuple[MaskSettings, MaskSettings] = (MaskSettings(), MaskSettings())
    gate: float = _bound(15.0, over=0)
    drop_ambiguous: bool = True
    elongated: float = _bound(0.8, most=1)
    punctate: float = _bound(0.6, least=0)
    least_elongated_um2: float | None = _bound(None, over=0)
    least_punctate_um2: float | None = _bound(None, over=0)
    background_percentile: float | None = _bound(None, least=0, most=100)

    def rules(self):
        yield from _channels(self.channels)
        if self.elongated <= self.punctate:
            yield "elongated must be over punctate"
        if (self.least_elongated_um2 or self.least_punctate_um2) and not self.calibration.pixel_um:
            yield "areas in square micrometres need pixel_um"


@dataclass(frozen=True)
class ParticleSettings(_Checked):
    """A run of the particle route."""

    sample: str = "sample"
    channels: tuple[int, ...] = (0,)
    spots: SpotSettings = field(default_factory=SpotSettings)
    links: LinkSettings = field(default_factory=LinkSettings)
    least_observations: int = _bound(3, int, least=1)
    calibration: Calibration = field(default_factory=Calibration)

    def rules(self):
        self.calibration.require_source()
        return _channels(self.channels)


_NESTED = {"calibration": Calibration, "spots": SpotSettings, "links": LinkSettings, "masks": MaskSettings}


def to_json(settings) -> str:
    return json.dumps(asdict(settings), sort_keys=True, allow_nan=False)


def from_json(kind: type, text: str):
    """Settings of a kind from JSON; unknown names are an error."""
    values = json.loads(text)
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = {}
    for name, value in values.items():
        if name in _NESTED and value is not None:
            inner = _NESTED[name]
            made[name] = tuple(inner(**v) for v in value) if isinstance(value, list) else inner(**value)
        else:
            made[name] = tuple(value) if isinstance(value, list) else value
    return kind(**made)


def run_id(settings, *inputs: str) -> str:
    """SHA-256 of the settings and the digests of the inputs."""
    return hashlib.sha256("\n".join([to_json(settings), *inputs]).encode()).hexdigest()
