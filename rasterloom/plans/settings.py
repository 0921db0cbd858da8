"""Settings of a burst job, their names, aliases and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The names that options and their values go by.
ALIASES = {
    "align": {"standard": "standard", "legacy": "standard", "dense": "dense", "dense-tile": "dense", "freq": "frequency", "frequency": "frequency", "skip": "skip", "none": "skip"},
    "merge": {
        "spatial": "spatial", "frequency": "frequency", "freq": "frequency", "median": "median", "temporal-median": "median",
        "temporal": "average", "temporal-average": "average", "average": "average", "avg": "average",
        "exp-bkt-average": "expbracket", "expbkt-avg": "expbracket", "expbkt": "expbracket", "bracket-average": "expbracket", "expbracket": "expbracket",
    },
    "spatial_mode": {"standard": "standard", "legacy": "standard", "linear": "linear"},
    "frequency_mode": {
        "laplacian": "laplacian", "legacy": "laplacian",
        "wiener": "wiener", "wiener-standard": "wiener", "wiener-v1": "wiener", "fft-standard": "wiener", "wiener-legacy": "wiener", "fft-legacy": "wiener",
        "wiener-robust": "wiener-robust", "wiener-v2": "wiener-robust", "fft": "wiener-robust", "wiener-fft": "wiener-robust",
    },
    "exposure": {"off": "off", "linear": "linear", "curve": "curve", "curve-global": "curve", "curve-local": "local", "local": "local"},
    "exposure_curve": {"global": "global", "standard": "global", "legacy": "global", "local": "local", "local-reinhard": "local"},
    "output_format": {"auto": "auto", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "dng": "dng"},
}
OPTIONS = {
    "t": "tile", "b": "depth", "bit-depth": "depth", "n": "noise_reduction", "noise-reduction": "noise_reduction", "m": "merge", "merge-algo": "merge",
    "a": "align", "alignment": "align", "spa-mode": "spatial_mode", "spatial-mode": "spatial_mode", "freq-mode": "frequency_mode", "frequency-mode": "frequency_mode",
    "exposure-mode": "exposure", "exposure-stops": "stops", "exposure-curve": "exposure_curve", "align-gamma": "gamma", "smooth-tile-field": "smooth",
    "highlight-recovery": "recovery", "hot-pixel-repair": "hot_pixels", "output-format": "output_format",
}


@dataclass(frozen=True)
class Settings:
    tile: int = 32
    search: int = 64
    align: str = "standard"
    merge: str = "spatial"
    spatial_mode: str = "standard"
    frequency_mode: str = "laplacian"
    noise_reduction: float = 13
    exposure: str = "off"
    exposure_curve: str = "global"
    stops: float = 0.0
    depth: int = 14
    gamma: float = 1.0
    smooth: bool = False
    recovery: bool = True
    hot_pixels: bool = False
    output_format: str = "auto"
    weighted: bool = False  # dense fields: means over the candidates instead of the cheapest

    def __post_init__(self):
        for name, known in ALIASES.items():
            value = str(getattr(self, name)).lower()
            if value not in known:
                raise ValueError(f"{name}: {value!r} is none of {', '.join(known)}")
            object.__setattr__(self, name, known[value])
        if self.exposure == "curve" and self.exposure_curve == "local":
            object.__setattr__(self, "exposure", "local")
        if self.depth not in (8, 10, 12, 14, 16):
            raise ValueError("depth is 8, 10, 12, 14 or 16")
        object.__setattr__(self, "tile", max(16, self.tile))

    @property
    def spatial_linear(self) -> bool:
        return self.spatial_mode == "linear"

    @classmethod
    def parse(cls, options: dict[str, str]) -> Settings:
        """Settings of options by their long or short names; `frequency` alone is short for that merge."""
        options = dict(options)
        read = {"int": int, "float": float, "str": str, "bool": lambda x: str(x).lower() in ("1", "true", "yes", "on")}
        if read["bool"](options.pop("frequency", False)):
            options.setdefault("merge", "frequency")
        named = {OPTIONS.get(k, k): v for k, v in options.items()}
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := named.keys() - kinds.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: read[kinds[k]](v) for k, v in named.items()})
