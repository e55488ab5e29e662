"""Whole jobs, and the checked queries over the test tables."""


def all_checks():
    """Every registered query by name."""
    from pairloom.plans import (  # noqa: F401
        label_checks,
        prompt_checks,
        relational_checks,
        response_checks,
        stage_checks,
        storage_checks,
        template_checks,
        workload_checks,
    )
    from pairloom.plans.registry import CHECKS

    return CHECKS
