"""All projection methods; importing this package registers them."""

from planisphere.methods import graph, layout, linear, parametric, stress, tsne  # noqa: F401
