"""Named queries over the given tables."""


def all_queries():
    from planisphere.plans import catalog_queries, graph_queries, layout_queries, linear_queries, neighbour_queries, run_queries  # noqa: F401
    from planisphere.plans.base import QUERIES

    return dict(QUERIES)


def all_sql():
    from planisphere.plans.base import ORACLE

    all_queries()
    return dict(ORACLE)
