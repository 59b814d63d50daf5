from .plans.jobs import main

if __name__ == "__main__":
    print(main())
