"""``python -m airshed <stage> ...`` runs the job CLI (see airshed.plans.jobs)."""

from airshed.plans.jobs import main

if __name__ == "__main__":
    main()
