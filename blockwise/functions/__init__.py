"""Column-level functions: R/tidyverse semantics, time, sun, geometry."""

from blockwise.functions.semantics import *  # noqa: F401,F403
