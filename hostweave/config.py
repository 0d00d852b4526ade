"""Settings of the correlation, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FuseConfig:
    """Windows are in seconds, host counts are inclusive minima."""

    window_seconds: int = 600
    resume_window_seconds: int = 3600
    min_hosts: int = 2
    split_on_shape_gap: bool = True
    hub_degree_bar: int | None = None
    recon_min_distinct: int = 5
    max_small_bytes: int = 50_000
    src_host_prefix: str = "host-"

    @property
    def window_us(self) -> int:
        return int(self.window_seconds * 1_000_000)

    @property
    def resume_us(self) -> int:
        return int(self.resume_window_seconds * 1_000_000)
