"""Entry script for ``spark-submit``; see ``turnstile/plans/cli.py``."""

from turnstile.plans.cli import main

if __name__ == "__main__":
    main()
