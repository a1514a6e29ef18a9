"""``python -m fluxsite ...`` runs the command line (see fluxsite.plans.cli)."""

from fluxsite.plans.cli import main

if __name__ == "__main__":
    for name, path in main().items():
        print(name, path)
