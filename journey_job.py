"""Entry point for spark-submit: its folder is where ``lapsekit`` is found."""

from lapsekit.plans.job import main

if __name__ == "__main__":
    main()
